"""The 41 pairwise features: two joins and one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import edit_ratios, jaccard, overlap
from ..functions.text import ngrams, numbers
from ..operators.blocking import FLAGS, S, T
from ..shipping import ensure_shipped

# The names of the features, in the order in which models read them.
FEATURES = (
    "f_name_exact", "f_name_core_exact", "f_name_fuzz_ratio", "f_name_partial_ratio", "f_name_token_sort_ratio", "f_name_token_set_ratio",
    "f_name_jaccard", "f_name_overlap", "f_name_len_diff", "f_name_len_ratio", "f_name_token_diff", "f_name_ngram_jaccard",
    "f_name_prefix_3", "f_name_prefix_5",
    "f_addr_exact", "f_addr_fuzz_ratio", "f_addr_partial_ratio", "f_addr_token_sort_ratio", "f_addr_token_set_ratio",
    "f_addr_jaccard", "f_addr_overlap", "f_addr_len_diff", "f_addr_len_ratio", "f_addr_num_overlap", "f_addr_num_jaccard", "f_addr_lead_num_match",
    "f_country_match", "f_country_missing", "f_country_conflict",
    "f_name_addr_mult", "f_name_addr_mean", "f_name_addr_harmonic", "f_name_high_addr_low", "f_addr_high_name_low",
    "f_block_exact_name", "f_block_nc", "f_block_addr", "f_block_tfidf", "f_block_rare", "f_tfidf_sim", "f_num_blocks",
)
EDIT = tuple(f for f in FEATURES if f.endswith(("fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")))
MIXED = FEATURES[29:34]
NATIVE = tuple(f for f in FEATURES if f not in EDIT + MIXED)
#: Features of whole numbers, which need no rounding.
WHOLE = (
    "f_name_exact", "f_name_core_exact", "f_name_len_diff", "f_name_token_diff", "f_name_prefix_3", "f_name_prefix_5",
    "f_addr_exact", "f_addr_len_diff", "f_addr_num_overlap", "f_addr_lead_num_match", *FEATURES[26:29], *FEATURES[32:39], "f_num_blocks",
)

_TEXTS = ("business_name_norm", "business_name_core", "business_address", "business_address_norm", "country_norm")
_ARRAYS = ("business_name_tokens", "business_address_tokens")


def paired(candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with the fields of both records (``s_…`` and ``t_…``), unless they hold them; missing records are empty."""
    if "s_business_name_norm" in candidates.columns:
        return candidates
    none = F.expr("cast(array() as array<string>)")

    def side(records: DataFrame, key: str, p: str) -> DataFrame:
        return records.select(F.col("entity_id").alias(key), *(F.col(c).alias(p + c) for c in _TEXTS + _ARRAYS))

    out = candidates.join(side(s1, S, "s_"), S, "left").join(side(targets, T, "t_"), T, "left")
    return out.withColumns({p + c: F.coalesce(F.col(p + c), F.lit("") if c in _TEXTS else none) for p in ("s_", "t_") for c in _TEXTS + _ARRAYS})


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _equal(a: Column, b: Column) -> Column:
    return _flag((a != "") & (a == b))


def _length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a), F.length(b))


def _prefix(a: Column, b: Column, n: int) -> Column:
    return _flag((F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)))


def native_features() -> dict[str, Column]:
    """Features that need no Python, over the columns of ``paired``."""
    s, t = (lambda c: F.col("s_" + c)), (lambda c: F.col("t_" + c))
    n1, n2, a1, a2 = s("business_name_norm"), t("business_name_norm"), s("business_address_norm"), t("business_address_norm")
    w1, w2, b1, b2 = (F.array_distinct(x) for x in (s("business_name_tokens"), t("business_name_tokens"), s("business_address_tokens"), t("business_address_tokens")))
    d1, d2 = numbers(s("business_address")), numbers(t("business_address"))
    c1, c2 = s("country_norm"), t("country_norm")
    both = (c1 != "") & (c2 != "")
    blocks = dict(zip(FEATURES[34:39], FLAGS.values(), strict=True))
    return {
        "f_name_exact": _equal(n1, n2),
        "f_name_core_exact": _equal(s("business_name_core"), t("business_name_core")),
        "f_name_jaccard": jaccard(w1, w2),
        "f_name_overlap": overlap(w1, w2),
        "f_name_len_diff": F.abs(F.length(n1) - F.length(n2)).cast("double"),
        "f_name_len_ratio": _length_ratio(n1, n2),
        "f_name_token_diff": F.abs(F.size(w1) - F.size(w2)).cast("double"),
        "f_name_ngram_jaccard": jaccard(ngrams(n1), ngrams(n2)),
        "f_name_prefix_3": _prefix(n1, n2, 3),
        "f_name_prefix_5": _prefix(n1, n2, 5),
        "f_addr_exact": _equal(a1, a2),
        "f_addr_jaccard": jaccard(b1, b2),
        "f_addr_overlap": overlap(b1, b2),
        "f_addr_len_diff": F.abs(F.length(a1) - F.length(a2)).cast("double"),
        "f_addr_len_ratio": _length_ratio(a1, a2),
        "f_addr_num_overlap": F.size(F.array_intersect(d1, d2)).cast("double"),
        "f_addr_num_jaccard": jaccard(d1, d2),
        "f_addr_lead_num_match": _flag((F.size(d1) > 0) & (F.size(d2) > 0) & F.coalesce(F.get(d1, F.lit(0)) == F.get(d2, F.lit(0)), F.lit(False))),
        "f_country_match": _flag(both & (c1 == c2)),
        "f_country_missing": _flag(~both),
        "f_country_conflict": _flag(both & (c1 != c2)),
        **{f: F.coalesce(F.col(c), F.lit(0)).cast("double") for f, c in blocks.items()},
        "f_tfidf_sim": F.coalesce(F.col("tfidf_similarity"), F.lit(0.0)).cast("double"),
        "f_num_blocks": F.coalesce(F.col("num_blocks_hit"), F.lit(1)).cast("double"),
    }


def pairwise_features(candidates: DataFrame, s1: DataFrame, targets: DataFrame, native_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Both ids, the columns of ``keep`` and the features in their order."""
    rows = paired(candidates, s1, targets)
    found = native_features()
    if native_only:
        return rows.select(S, T, *keep, *(found[f].alias(f) for f in NATIVE))
    ensure_shipped(candidates.sparkSession)
    rows = rows.withColumns({"__n": edit_ratios("s_business_name_norm", "t_business_name_norm"), "__a": edit_ratios("s_business_address_norm", "t_business_address_norm")})
    for p, u in (("f_name_", "__n"), ("f_addr_", "__a")):
        found |= {p + "fuzz_ratio": F.col(u)["ratio"]} | {p + x: F.col(u)[x] for x in ("partial_ratio", "token_sort_ratio", "token_set_ratio")}
    name, addr = found["f_name_token_set_ratio"], found["f_addr_token_set_ratio"]
    found |= {
        "f_name_addr_mult": name * addr,
        "f_name_addr_mean": (name + addr) / 2,
        "f_name_addr_harmonic": F.when(name + addr > 0, 2 * name * addr / (name + addr)).otherwise(0.0),
        "f_name_high_addr_low": _flag((name > 0.85) & (addr < 0.35)),
        "f_addr_high_name_low": _flag((addr > 0.85) & (name < 0.35)),
    }
    return rows.select(S, T, *keep, *(found[f].alias(f) for f in FEATURES))
