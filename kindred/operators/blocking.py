"""Candidate generation: five blocking strategies and their union.

A strategy gives (source1_entity_id, candidate_entity_id) pairs of two
normalised tables by key equality; no pair is formed outside a shared key.
Blocks of too many targets are left out by rule (a count per key, which also
bounds the join's fan-out). The TF-IDF join scores the distinct names of both
sides against each other by inverted indexes and loses none of the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BlockingConfig
from ..functions.text import tokens
from ..shipping import ensure_shipped
from ..sources.records import truth_pairs
from ..storage import stored

S, T = "source1_entity_id", "candidate_entity_id"
STRATEGIES = ("exact_name", "name_country", "address_token", "tfidf_ngram", "rare_token")
# The flag column of each strategy.
FLAGS = {
    "exact_name": "blocked_by_exact_name",
    "name_country": "blocked_by_name_country",
    "address_token": "blocked_by_address",
    "tfidf_ngram": "blocked_by_tfidf",
    "rare_token": "blocked_by_rare_token",
}
# Address tokens too common for a block.
ADDRESS_STOPS = ("street", "road", "avenue", "boulevard", "suite", "floor", "apartment", "lane", "drive", "main", "city")


def key_index(records: DataFrame, key: Column, many: bool = False, name: str = "entity_id") -> DataFrame:
    """(key, id) entries of an inverted index; empty keys are dropped, repeats kept.

    ``key`` is a string, or with ``many`` an array of strings.
    """
    entries = records.select((F.explode(key) if many else key).alias("key"), F.col("entity_id").alias(name))
    return entries.filter(F.col("key").isNotNull() & (F.col("key") != ""))


def join_keys(left: DataFrame, right: DataFrame, cap: int | None = None, many: bool = True) -> DataFrame:
    """Distinct pairs that share a key; with ``cap``, keys of at most that many target entries.

    Records of one key each (not ``many``) and unique ids can't repeat a pair,
    so they are spared the shuffle that makes pairs distinct.
    """
    if cap is not None:
        small = right.groupBy("key").count().filter(F.col("count") <= cap).select("key")
        right = right.join(small, "key", "left_semi")
    pairs = left.join(right, "key").select(S, T)
    return pairs.distinct() if many else pairs


def exact_name(s1: DataFrame, targets: DataFrame, config: BlockingConfig) -> DataFrame:
    key = F.col("business_name_norm")
    return join_keys(key_index(s1, key, name=S), key_index(targets, key, name=T), many=False)


def name_country(s1: DataFrame, targets: DataFrame, config: BlockingConfig) -> DataFrame:
    key = F.when((F.col("business_name_core") != "") & (F.col("country_norm") != ""), F.concat_ws("___", "business_name_core", "country_norm"))
    return join_keys(key_index(s1, key, name=S), key_index(targets, key, name=T), many=False)


def address_keys(config: BlockingConfig) -> Column:
    informative = F.filter("business_address_tokens", lambda t: ~t.isin(*ADDRESS_STOPS) & ((F.length(t) > 3) | t.rlike("^[0-9]+$")))
    return F.slice(informative, 1, config.address_keys)


def address_token(s1: DataFrame, targets: DataFrame, config: BlockingConfig) -> DataFrame:
    key = address_keys(config)
    return join_keys(key_index(s1, key, True, S), key_index(targets, key, True, T), config.address_block_cap)


def token_frequency(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, n): occurrences of core-name tokens over both tables."""
    name = F.col("business_name_tokens")
    both = key_index(s1, name, True).unionByName(key_index(targets, name, True))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def rare_token(s1: DataFrame, targets: DataFrame, config: BlockingConfig, corpus: DataFrame | None = None) -> DataFrame:
    """Pairs by rare tokens; ``corpus`` is a frozen ``token_frequency`` for serving."""
    counts = corpus if corpus is not None else token_frequency(s1, targets)
    rare = counts.filter(F.col("n").between(config.rare_min_freq, config.rare_max_freq) & (F.length("key") >= 3)).select("key")
    name = F.col("business_name_tokens")
    left = key_index(s1, name, True, S).join(rare, "key", "left_semi")
    right = key_index(targets, name, True, T).join(rare, "key", "left_semi")
    return join_keys(left, right, config.rare_block_cap)


#: Names of one block and of one shard of targets at most, which bound what a task of the TF-IDF join holds.
BLOCK, SHARD = 16384, 131072
#: Norm of what a record's vector leaves out in the first round of scoring.
REST = 0.2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(padded: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the character n-grams within the words of many texts, repeats kept.

    In the texts each word stands between two spaces of its own, so that of
    all spaces every other one begins a word. A code is a 64-bit hash.
    """
    sizes = np.array([len(t) for t in padded], dtype=np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = points == 32
    word = (np.cumsum(space) - space) // 2
    text = np.repeat(np.arange(len(padded)), sizes)
    texts, codes = [], []
    with np.errstate(over="ignore"):
        code, power = np.zeros(len(points), dtype=np.uint64), np.uint64(1)
        for n in range(1, high + 1):
            count = len(points) - n + 1
            if count <= 0:
                break
            power *= _MIX
            code = code[:count] + (points[n - 1 :].astype(np.uint64) + np.uint64(1)) * power
            if n >= low:
                inside = word[:count] == word[n - 1 :]
                texts.append(text[:count][inside])
                codes.append(code[inside])
    return (np.concatenate(texts), np.concatenate(codes)) if texts else (text[:0], np.empty(0, dtype=np.uint64))


def record_names(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(side, id, name): one row per record; records that share an id are one document."""
    rows = s1.select(F.lit(0).alias("side"), F.col("entity_id").alias("id"), "business_name_norm").unionByName(targets.select(F.lit(1).alias("side"), F.col("entity_id").alias("id"), "business_name_norm"))
    return rows.groupBy("side", "id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("business_name_norm"))).alias("name"))


def _padded(name: Column) -> Column:
    return F.concat_ws("", F.transform(tokens(F.lower(name)), lambda w: F.concat(F.lit(" "), w, F.lit(" "))))


def gram_weights(names: DataFrame, total: int, config: BlockingConfig) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams, sorted, and their inverse document frequencies, from (padded, n): texts and how many records have them.

    These reach the driver, 16 bytes a gram. Normalised names are ASCII, so
    that short grams run out, however many names there are.
    """
    low, high = config.ngram_range

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, code = gram_codes(list(pdf["padded"]), low, high)
            order = np.lexsort((code, text))
            text, code = text[order], code[order]
            new = np.ones(len(code), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
            codes, at = np.unique(code[new], return_inverse=True)
            yield pd.DataFrame({"code": codes.view(np.int64), "n": np.bincount(at, pdf["n"].to_numpy()[text[new]], len(codes)).astype(np.int64)})

    got = names.mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, df = got["code"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(codes)
    return codes[order], np.log((1 + total) / (1 + df[order])) + 1


def vectors(padded: list[str], grams: np.ndarray, idf: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L2-normalised vectors of texts: where each one's entries end, their grams (numbers in ``grams``) and their weights."""
    text, code = gram_codes(padded, low, high)
    key, tf = np.unique(text * len(grams) + np.searchsorted(grams, code), return_counts=True)
    text, gram = key // max(1, len(grams)), key % max(1, len(grams))
    weight = (1 + np.log(tf)) * idf[gram]
    norm = np.sqrt(np.bincount(text, weight * weight, len(padded)))
    return np.cumsum(np.bincount(text, minlength=len(padded))), gram, weight / norm[text]


class NameIndex:
    """The vectors of some names by name and by gram."""

    def __init__(self, ends: np.ndarray, gram: np.ndarray, weight: np.ndarray, idf: np.ndarray) -> None:
        self.size, self.idf = len(ends), idf
        self.sizes, self.gram, self.weight = np.diff(ends, prepend=0), gram.astype(np.int32), weight
        self.starts = ends - self.sizes
        order = np.argsort(self.gram, kind="stable")
        # Weights by gram hold the gram's frequency twice, as most grams occur in a record's name once.
        self.owner, self.by_gram = np.repeat(np.arange(self.size), self.sizes)[order], (weight * idf[gram])[order]
        self.df = np.bincount(self.gram, minlength=len(idf))
        self.to = np.cumsum(self.df)
        self.dense = np.zeros(len(idf))

    def _waiting(self, at: np.ndarray) -> np.ndarray:
        """What the weights in ``dense`` add to the products of some names."""
        if not len(at):
            return np.empty(0)
        n = self.sizes[at]
        first = np.cumsum(n) - n
        place = np.repeat(self.starts[at] - first, n) + np.arange(n.sum())
        return np.add.reduceat(self.dense[self.gram[place]] * self.weight[place], first)

    def search(self, gram: np.ndarray, weight: np.ndarray, limit: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Names with a dot product of ``limit`` or more, and these; with ``most`` only that many best, ties by number.

        The record's commonest grams wait, as far as their norm is small: a
        name's product grows by that norm at most, so only names that can
        still be among the best are looked up for them.
        """
        df = self.df[gram]
        order = np.argsort(-df, kind="stable")
        rest = np.sqrt(np.cumsum(weight[order] ** 2))
        cut = int(np.searchsorted(rest, min(REST, 0.8 * limit) if most else 0.0, "right"))
        later, now = order[:cut], order[cut:]
        now = now[df[now] > 0]
        slack = (rest[cut - 1] if cut else 0.0) + 1e-9
        if not len(now):
            return np.empty(0, dtype=np.int64), np.empty(0)
        times = weight[now] / self.idf[gram[now]]
        unit = times.min()
        ends, owners, parts = self.to[gram[now]], [], []
        for a, b, x in zip((ends - df[now]).tolist(), ends.tolist(), np.round(times / unit, 12).tolist(), strict=True):
            owners.append(self.owner[a:b])
            parts.append(self.by_gram[a:b] if x == 1 else self.by_gram[a:b] * x)
        sims = np.bincount(np.concatenate(owners), np.concatenate(parts), self.size) * unit
        at = np.flatnonzero(sims >= max(limit - slack, 1e-12))
        self.dense[gram[later]] = weight[later]
        if most and len(at) > most:
            best = at[np.argpartition(sims[at], -most)[-most:]]
            at = at[sims[at] >= max(limit, (sims[best] + self._waiting(best)).min()) - slack]
        found = sims[at] + self._waiting(at)
        self.dense[gram[later]] = 0
        keep = found >= limit - 1e-9
        at, found = at[keep], found[keep]
        if most and len(at) > most:
            top = np.lexsort((at, -np.round(found, 9)))[:most]
            at, found = at[top], found[top]
        return at, found


def name_matches(names: DataFrame, total: int, config: BlockingConfig, most: int | None = None) -> DataFrame:
    """(s_name, t_name, sim) of all names of records and of targets with a cosine of at least the limit.

    ``names`` holds (name, padded, n, ours, theirs, first): in how many tables'
    rows a name stands, on which sides, and the least id of its targets. Only
    names travel; a task makes the vectors of a shard of targets and asks for
    its block of records by an inverted index. With ``most`` a shard returns
    only that many best names, ties by their first ids.
    """
    spark = names.sparkSession
    ensure_shipped(spark)
    (low, high), limit = config.ngram_range, config.tfidf_min_similarity
    known = spark.sparkContext.broadcast(gram_weights(names, total, config))
    r = names.agg(F.count_if("ours").alias("a"), F.count_if("theirs").alias("b")).first()
    blocks = max(1, -(-r["a"] // BLOCK), min(2 * spark.sparkContext.defaultParallelism, r["a"] // 128))
    shards = max(1, -(-r["b"] // SHARD))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, idf = known.value
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("first")
        found = []
        if len(left) and len(right):
            index, theirs = NameIndex(*vectors(list(right["padded"]), grams, idf, low, high), idf), right["name"].to_numpy()
            ends, gram, weight = vectors(list(left["padded"]), grams, idf, low, high)
            for name, a, b in zip(left["name"], np.concatenate([[0], ends[:-1]]), ends, strict=True):
                at, sims = index.search(gram[a:b], weight[a:b], limit, most)
                if len(at):
                    found.append((name, theirs[at], sims))
        return pd.DataFrame({
            "s_name": np.repeat(np.array([f[0] for f in found], dtype=object), [len(f[1]) for f in found]) if found else [],
            "t_name": np.concatenate([f[1] for f in found]) if found else [],
            "sim": np.concatenate([f[2] for f in found]) if found else [],
        }).astype({"s_name": object, "t_name": object, "sim": float})

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = names.filter("ours").select(F.lit(0).alias("side"), "name", "padded", F.lit("").alias("first"), F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"), numbers(shards).alias("shard"))
    theirs = names.filter("theirs").select(F.lit(1).alias("side"), "name", "padded", "first", numbers(blocks).alias("block"), F.pmod(F.xxhash64("name", F.lit(1)), F.lit(shards)).cast("int").alias("shard"))
    # A task's work is more than its bytes say, so tasks must not be coalesced.
    dealt = ours.unionByName(theirs).repartition(blocks * shards, "block", "shard")
    scored = dealt.groupBy("block", "shard").applyInPandas(run, "s_name string, t_name string, sim double")
    return scored.withColumn("sim", F.round("sim", 9)).filter(F.col("sim") >= limit)


def _matches(s1: DataFrame, targets: DataFrame, config: BlockingConfig, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The matches of names, and (side, id, name)."""
    # Read by the counts of grams, by the search and by both joins that follow.
    rows = record_names(s1, targets).persist()
    names = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("side") == 0).alias("ours"), F.max(F.col("side") == 1).alias("theirs"), F.min(F.when(F.col("side") == 1, F.col("id"))).alias("first"))
    names = names.withColumn("padded", _padded(F.col("name"))).filter("padded <> ''").persist()
    return name_matches(names, s1.count() + targets.count(), config, most), rows


def tfidf_pairs(s1: DataFrame, targets: DataFrame, config: BlockingConfig, most: int | None = None) -> DataFrame:
    """(ids, sim) of all pairs with a cosine of at least the limit.

    Equal names have equal vectors, so names are compared, not records. With
    ``most`` only the pairs that can be among a record's that many best, or
    some more.
    """
    found, rows = _matches(s1, targets, config, most)
    ours, theirs = rows.filter("side = 0").select(F.col("id").alias(S), F.col("name").alias("s_name")), _first_ids(rows, most)
    return found.join(theirs, "t_name").join(ours, "s_name").select(S, T, "sim")


def _first_ids(rows: DataFrame, most: int | None) -> DataFrame:
    """(candidate id, t_name): the targets of each name, with ``most`` the first ones."""
    theirs = rows.filter("side = 1").select(F.col("id").alias(T), F.col("name").alias("t_name"))
    if most is None:
        return theirs
    return theirs.withColumn("r", F.row_number().over(Window.partitionBy("t_name").orderBy(T))).filter(F.col("r") <= most).drop("r")


def top_k(pairs: DataFrame, k: int, by: str = S) -> DataFrame:
    """The k most similar targets of each record, ties by id."""
    best = Window.partitionBy(by).orderBy(F.desc("sim"), T)
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def tfidf_best(s1: DataFrame, targets: DataFrame, config: BlockingConfig) -> tuple[DataFrame, DataFrame]:
    """(s_name, candidate id, sim) of the most similar targets of each distinct name, and (side, id, name)."""
    k = config.tfidf_top_k
    found, rows = _matches(s1, targets, config, k)
    return top_k(found.join(_first_ids(rows, k), "t_name"), k, "s_name"), rows


def tfidf_ngram(s1: DataFrame, targets: DataFrame, config: BlockingConfig) -> DataFrame:
    best, rows = tfidf_best(s1, targets, config)
    return best.join(rows.filter("side = 0").select(F.col("id").alias(S), F.col("name").alias("s_name")), "s_name").select(S, T, "sim")


Strategy = Callable[[DataFrame, DataFrame, BlockingConfig], DataFrame]
BUILT_IN: dict[str, Strategy] = {
    "exact_name": exact_name,
    "name_country": name_country,
    "address_token": address_token,
    "tfidf_ngram": tfidf_ngram,
    "rare_token": rare_token,
}


def custom_strategy(key: Column, many: bool = False, cap: int | None = None) -> Strategy:
    """A strategy from a key expression, with a block cap if wanted."""
    return lambda s1, targets, config: join_keys(key_index(s1, key, many, S), key_index(targets, key, many, T), cap, many)


# The fields of a record on which keys of the built-in strategies and features depend.
FIELDS = (
    "business_name_norm", "business_name_core", "business_address", "business_address_norm", "country_norm",
    "business_name_tokens", "business_address_tokens",
)
#: Records of one group at most, and pairs of one task of the join, give or take a group.
GROUP, PAIRS = 256, 1 << 20


@dataclass
class Linked:
    """Candidate pairs of groups of like records.

    Records with equal fields have the same candidates, so ``rows`` has one
    row per group and target: the group's first id, the target's, flags,
    similarity, number of blocks and ``ids``, the records of the group. Where
    the truth was given, ``true`` holds those of them that it matches with the
    target, or null. ``members`` holds (id, group) of every record.
    """

    rows: DataFrame
    members: DataFrame


def expanded(rows: DataFrame) -> DataFrame:
    """One row per record instead of one per group."""
    return rows.select(F.explode("ids").alias(S), *(c for c in rows.columns if c not in (S, "ids", "true")))


def true_of_groups(truth: DataFrame, members: DataFrame) -> DataFrame:
    """(group, target, true): the records of a group that the truth matches with a target, as an array in ``true``; see ``Linked``."""
    of = truth_pairs(truth).distinct().join(members, S)
    return of.groupBy(F.col("group").alias(S), T).agg(F.collect_list(of[S]).alias("true"))


def grouped(s1: DataFrame) -> DataFrame:
    """Groups of records with equal fields: the first id as ``entity_id``, the fields, and all ``ids``."""
    whole = s1.groupBy(*FIELDS).agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"int((size(ids) - 1) div {GROUP})")), lambda k: F.slice("ids", k * GROUP + 1, GROUP))
    return whole.withColumn("ids", F.explode(parts)).select(F.get("ids", F.lit(0)).alias("entity_id"), *FIELDS, "ids")


def _unlike(records: DataFrame) -> bool:
    """Whether ids repeat or lack."""
    return bool(records.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or entity_id is null").limit(1).collect())


def linked(
    s1: DataFrame, targets: DataFrame, config: BlockingConfig | None = None, strategies=STRATEGIES, extra: dict[str, Strategy] | None = None, truth: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> Linked:
    """The candidates of groups of like records; see ``candidates``.

    What the strategies other than names find, and what the truth says, stands
    in one stored row per group. Pairs of equal names, or of equal core names
    and countries, are as many as groups of copies want. They come from a join
    of these rows with the targets by name, whose large keys are salted, so
    that none of them is shuffled. ``carry`` names further columns of the
    targets that the rows hold, as ``shown_…``. Repeated or missing ids and ``extra``
    strategies, whose keys may be anything, take each record as a group.
    """
    config = config or BlockingConfig()
    if extra or not strategies or _unlike(s1) or _unlike(targets):
        rows = _union(s1, targets, config, strategies, extra or {}).withColumn("ids", F.array(S))
        members = s1.select(F.col("entity_id").alias(S), F.col("entity_id").alias("group")).distinct()
        if carry:
            rows = rows.join(targets.select(F.col("entity_id").alias(T), *(F.col(c).alias("shown_" + c) for c in carry)), T, "left")
        return Linked(rows if truth is None else rows.join(true_of_groups(truth, members), [S, T], "left"), members)
    spark = s1.sparkSession
    # Read by every strategy and by the join.
    groups = grouped(s1).persist()
    members = groups.select(F.explode("ids").alias(S), F.col("entity_id").alias("group"))
    mine, name = groups.withColumnRenamed("entity_id", S), F.col("business_name_norm")
    found = []
    if "address_token" in strategies:
        found.append(("address_token", address_token(groups, targets, config)))
    if "rare_token" in strategies:
        found.append(("rare_token", rare_token(groups, targets, config, token_frequency(s1, targets))))
    if "tfidf_ngram" in strategies:
        found.append(("tfidf_ngram", tfidf_best(s1, targets, config)[0].join(mine.select(S, name.alias("s_name")), "s_name")))
    no_one = F.lit(None).cast("string").alias("who")
    nothing = groups.limit(0).select(F.col("entity_id").alias(S), F.col("entity_id").alias(T), F.lit(0).alias("bits"), F.lit(0.0).alias("sim"), no_one)
    tagged = [p.select(S, T, F.lit(1 << STRATEGIES.index(n)).alias("bits"), (F.col("sim") if n == "tfidf_ngram" else F.lit(0.0)).alias("sim"), no_one) for n, p in found]
    if truth is not None:
        said = truth_pairs(truth).withColumnRenamed(S, "who").join(members.withColumnRenamed(S, "who"), "who")
        tagged.append(said.select(F.col("group").alias(S), T, F.lit(0).alias("bits"), F.lit(0.0).alias("sim"), "who"))
    theirs = targets.select(F.col("entity_id").alias(T), name.alias("key"), *(F.col(c).alias("t_" + c) for c in FIELDS), *(F.col(c).alias("shown_" + c) for c in carry))
    # Few pairs per group, dealt by group once: a task's work is more than its bytes say, so tasks must not be coalesced.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = reduce(DataFrame.unionByName, tagged, nothing).join(theirs.select(T, "key"), T).repartition(parts, S)
    near = near.groupBy(S, T).agg(F.bit_or("bits").alias("bits"), F.max("sim").alias("sim"), F.collect_set("who").alias("true"), F.first("key").alias("key"))
    near = near.groupBy(S).agg(F.collect_list(F.struct(T, "bits", "sim", F.when(F.size("true") > 0, F.col("true")).alias("true"), "key")).alias("near"))
    keys = _name_keys(mine, targets, strategies).persist()
    loads = keys.groupBy("key").agg(F.sum("n").alias("a")).join(theirs.groupBy("key").agg(F.count(F.lit(1)).alias("b")), "key")
    loads = loads.select("key", (F.col("a") * F.col("b")).alias("pairs"), F.least("b", F.ceil(F.col("a") * F.col("b") / PAIRS)).cast("int").alias("salts")).persist()
    total = loads.agg(F.sum("pairs")).first()[0] or 0
    tasks = min(4096, max(parts, total // PAIRS))
    hot, one = loads.filter("salts > 1").select("key", "salts"), F.coalesce("salts", F.lit(1))
    ours = mine.select(S, "ids", *(F.col(c).alias("s_" + c) for c in FIELDS)).repartition(parts, S)
    ours = ours.join(keys.repartition(parts, S).groupBy(S).agg(F.collect_list("key").alias("keys")), S, "left").join(near, S, "left")
    none = F.expr("cast(array() as array<string>)")
    # Read by the join, and for what it has no key for.
    ours = stored(ours.withColumn("keys", F.coalesce("keys", none)).withColumn("near", F.coalesce("near", F.filter("near", lambda x: F.lit(False)))), "near")
    fields = ["ids", *("s_" + c for c in FIELDS)]
    left = ours.select(S, *fields, "near", F.explode("keys").alias("key"))
    same = F.filter("near", lambda x: x["key"] == F.col("key"))
    left = left.withColumn("near", F.transform(same, lambda x: F.struct(x[T].alias(T), x["bits"].alias("bits"), x["sim"].alias("sim"), x["true"].alias("true"))))
    left = left.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    right = theirs.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64(T), one).cast("int")).drop("salts")
    met = left.repartition(tasks, "key", "salt").join(right.repartition(tasks, "key", "salt"), ["key", "salt"])
    hit = F.get(F.filter("near", lambda x: x[T] == F.col(T)), F.lit(0))
    met = met.withColumn("hit", hit).withColumns({"bits": F.coalesce(F.col("hit.bits"), F.lit(0)), "sim": F.coalesce(F.col("hit.sim"), F.lit(0.0)), "true": F.col("hit.true")})
    far = ours.select(S, F.explode(F.filter("near", lambda x: ~F.array_contains("keys", x["key"]))).alias("hit"))
    far = far.select(S, f"hit.{T}", "hit.bits", "hit.sim", "hit.true").join(theirs.drop("key"), T).join(ours.select(S, *fields), S)
    columns = [S, T, "ids", "bits", "sim", *(["true"] if truth is not None else []), *(p + c for p in ("s_", "t_") for c in FIELDS), *("shown_" + c for c in carry)]
    both = met.select(columns).unionByName(far.select(columns))
    equal = lambda c: (F.col("s_" + c) != "") & (F.col("s_" + c) == F.col("t_" + c))
    flags = {n: F.col("bits").bitwiseAND(1 << k).cast("boolean") for k, n in enumerate(STRATEGIES)}
    flags |= {"exact_name": equal("business_name_norm"), "name_country": equal("business_name_core") & equal("country_norm")}
    out = both.withColumns({FLAGS[n]: c.cast("int") if n in strategies else F.lit(0) for n, c in flags.items()})
    out = out.withColumn("num_blocks_hit", reduce(lambda a, b: a + b, (F.col(f) for f in FLAGS.values()))).filter("num_blocks_hit > 0")
    return Linked(out.select(S, T, "ids", *FLAGS.values(), F.col("sim").alias("tfidf_similarity"), "num_blocks_hit", *columns[5:]), members)


def _name_keys(groups: DataFrame, targets: DataFrame, strategies) -> DataFrame:
    """(group, key, n): the normalised names of the targets that a group meets, and its number of records."""
    name, n = F.col("business_name_norm"), F.size("ids").alias("n")
    own = groups.filter(name != "").select(S, name.alias("key"), n)
    if "name_country" not in strategies:
        return own if "exact_name" in strategies else own.limit(0)
    core = ["business_name_core", "country_norm"]
    named = targets.filter("business_name_core <> '' and country_norm <> ''").select(*core, name.alias("key")).distinct()
    alike = groups.select(S, *core, name.alias("own"), n).join(named, core)
    if "exact_name" not in strategies:
        return alike.select(S, "key", "n")
    return own.unionByName(alike.filter("key <> own").select(S, "key", "n"))


def candidates(s1: DataFrame, targets: DataFrame, config: BlockingConfig | None = None, strategies=STRATEGIES, extra: dict[str, Strategy] | None = None) -> DataFrame:
    """Candidate pairs with a 0/1 flag per strategy, TF-IDF similarity and number of blocks.

    ``s1`` and ``targets`` are normalised tables; persist them if they are not
    stored, as every strategy reads both. ``extra`` strategies get a flag
    ``blocked_by_<name>`` of their own and count as blocks.
    """
    out = expanded(linked(s1, targets, config, strategies, extra).rows)
    return out.select(S, T, *FLAGS.values(), *(f"blocked_by_{n}" for n in extra or {}), "tfidf_similarity", "num_blocks_hit")


def _union(s1: DataFrame, targets: DataFrame, config: BlockingConfig, strategies, extra: dict[str, Strategy]) -> DataFrame:
    """``candidates`` of single records, by a union of all strategies' pairs."""
    flags = FLAGS | {n: f"blocked_by_{n}" for n in extra}
    chosen = {n: BUILT_IN[n] for n in strategies} | extra
    tagged = []
    for name, strategy in chosen.items():
        pairs = strategy(s1, targets, config)
        sim = F.col("sim") if "sim" in pairs.columns else F.lit(0.0)
        tagged.append(pairs.select(S, T, *((F.lit(int(n == name))).alias(f) for n, f in flags.items()), sim.alias("tfidf_similarity")))
    if not tagged:
        empty = s1.limit(0).select(F.col("entity_id").alias(S), F.col("entity_id").alias(T))
        tagged = [empty.select(S, T, *(F.lit(0).alias(f) for f in flags.values()), F.lit(0.0).alias("tfidf_similarity"))]
    union = reduce(DataFrame.unionByName, tagged)
    out = union.groupBy(S, T).agg(*(F.max(f).alias(f) for f in flags.values()), F.max("tfidf_similarity").alias("tfidf_similarity"))
    return out.withColumn("num_blocks_hit", reduce(lambda a, b: a + b, (F.col(f) for f in flags.values())))
