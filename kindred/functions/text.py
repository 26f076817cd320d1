"""Column functions that normalise business names, addresses and countries.

All of them stay in the JVM except ``fold``, whose Unicode decomposition has
no built-in counterpart; it hands only texts outside ASCII to an Arrow UDF.
A missing value is the empty string throughout.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ensure_shipped

# Ordered rewrites of legal forms.
LEGAL_FORMS = (
    (r"\b(private\s+limited|pvt\s*\.?\s*ltd\.?|pvt\s+ltd)\b", " pvt ltd "),
    (r"\b(proprietary\s+limited|pty\s*\.?\s*ltd\.?)\b", " pty ltd "),
    (r"\b(pte\s*\.?\s*ltd\.?)\b", " pte ltd "),
    (r"\b(limited\s+liability\s+company|llc)\b", " llc "),
    (r"\b(limited\s+liability\s+partnership|llp)\b", " llp "),
    (r"\b(incorporated|inc\.?)\b", " inc "),
    (r"\b(corporation|corp\.?)\b", " corp "),
    (r"\b(company|co\.?)\b", " co "),
    (r"\b(limited|ltd\.?)\b", " ltd "),
    (r"\b(gmbh\s*&\s*co\s*\.?\s*kg|gmbh)\b", " gmbh "),
    (r"\b(kabushiki\s+kaisha|k\s*\.?\s*k\.?)\b", " kk "),
    (r"\b(godo\s+kaisha|g\s*\.?\s*k\.?)\b", " gk "),
    (r"\b(besloten\s+vennootschap|b\s*\.?\s*v\.?)\b", " bv "),
    (r"\b(naamloze\s+vennootschap|n\s*\.?\s*v\.?)\b", " nv "),
    (r"\b(societe\s+anonyme|s\s*\.?\s*a\.?)\b", " sa "),
    (r"\b(sarl|sas)\b", " sa "),
    (r"\b(ag|ug)\b", " ag "),
)

# Punctuation, as a character class.
PUNCTUATION = r"""[\.,;:!\?\"'’`\(\)\[\]\{\}<>\\/\|\-_+=~*^&#@$%]"""

# Tokens that a core name leaves out.
LEGAL_TOKENS = ("ltd", "limited", "inc", "corp", "llc", "llp", "gmbh", "pvt", "pty", "pte", "co", "bv", "sa", "ag")

# Expansions of tokens in names and in addresses. Keys with punctuation (an abbreviation with a point, the
# ampersand) are left out, as tokens hold none when they are looked up.
NAME_EXPANSIONS = {
    "tech": "technologies",
    "techno": "technologies",
    "technology": "technologies",
    "soln": "solutions",
    "solns": "solutions",
    "solution": "solutions",
    "intl": "international",
    "sys": "systems",
    "system": "systems",
    "ent": "enterprises",
    "enterprise": "enterprises",
    "mfg": "manufacturing",
    "svcs": "services",
    "svc": "services",
    "service": "services",
    "grp": "group",
    "mgmt": "management",
    "comm": "communications",
    "dist": "distribution",
    "corp": "corporation",
    "assoc": "associates",
    "eng": "engineering",
    "engg": "engineering",
    "dev": "development",
    "pharma": "pharmaceuticals",
    "pharm": "pharmaceuticals",
    "chem": "chemical",
    "hldg": "holdings",
    "hldgs": "holdings",
}
ADDRESS_EXPANSIONS = {
    "st": "street",
    "str": "street",
    "rd": "road",
    "ave": "avenue",
    "av": "avenue",
    "blvd": "boulevard",
    "bld": "boulevard",
    "dr": "drive",
    "ln": "lane",
    "hwy": "highway",
    "fl": "floor",
    "ste": "suite",
    "apt": "apartment",
    "pkwy": "parkway",
    "pl": "place",
    "sq": "square",
    "ctr": "center",
    "cntr": "center",
    "bldg": "building",
    "no": "number",
    "dept": "department",
    "ind": "industrial",
    "dist": "district",
    "sec": "sector",
}

# Stop words of tokens.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "by", "with")

WHITE = r"[\s\x1c-\x1f]+"
TEXT_COLUMNS = ("business_name", "business_address", "country")


def fold_text(text: str) -> str:
    """NFKD without what lies outside ASCII."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def fold(text: Column) -> Column:
    """Accents and everything else outside ASCII removed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    foreign = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_fold(foreign), text)


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def tokens(text: Column) -> Column:
    """Parts between white space, in order, none empty."""
    return F.filter(F.split(text, WHITE), lambda t: t != "")


def _expanded(parts: Column, expansions: dict[str, str]) -> Column:
    table = _map(expansions)
    return F.transform(parts, lambda t: F.coalesce(F.element_at(table, t), t))


def _name_parts(folded: Column) -> Column:
    standard = reduce(lambda c, rule: F.regexp_replace(c, *rule), LEGAL_FORMS, F.lower(folded))
    return tokens(F.regexp_replace(standard, PUNCTUATION, " "))


def name_norm(folded: Column) -> Column:
    """The normalised form of an already folded name."""
    return F.array_join(_expanded(_name_parts(folded), NAME_EXPANSIONS), " ")


def name_core(folded: Column) -> Column:
    """The normalised form without legal tokens, which go before expansion."""
    kept = F.filter(_name_parts(folded), lambda t: ~t.isin(*LEGAL_TOKENS))
    return F.array_join(_expanded(kept, NAME_EXPANSIONS), " ")


def address_norm(folded: Column) -> Column:
    return F.array_join(_expanded(tokens(F.regexp_replace(F.lower(folded), PUNCTUATION, " ")), ADDRESS_EXPANSIONS), " ")


def country_norm(folded: Column) -> Column:
    stripped = F.regexp_replace(folded, rf"^{WHITE}|{WHITE}$", "")
    return F.regexp_replace(F.upper(stripped), PUNCTUATION, "")


def content_tokens(norm: Column) -> Column:
    """Tokens without stop words and without those of one character."""
    return F.filter(tokens(norm), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def numbers(raw: Column) -> Column:
    """The distinct digit runs of a raw text, by first place."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(?U)\b\d+\b"), 0))


def ngrams(text: Column, n: int = 3) -> Column:
    """The distinct character n-grams; a shorter text is its own, an empty one has none."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    none = F.expr("cast(array() as array<string>)")
    return F.when(text == "", none).when(F.length(text) <= n, F.array(text)).otherwise(many)


def normalized(records: DataFrame) -> DataFrame:
    """Adds the six normalised columns; raw columns and extra ones stay."""
    ensure_shipped(records.sparkSession)
    filled = records.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in TEXT_COLUMNS})
    folded = filled.withColumns({f"__{c}": fold(F.col(c)) for c in TEXT_COLUMNS})
    out = folded.withColumns({
        "business_name_norm": name_norm(F.col("__business_name")),
        "business_name_core": name_core(F.col("__business_name")),
        "business_address_norm": address_norm(F.col("__business_address")),
        "country_norm": country_norm(F.col("__country")),
    })
    out = out.withColumns({
        "business_name_tokens": content_tokens(F.col("business_name_core")),
        "business_address_tokens": content_tokens(F.col("business_address_norm")),
    })
    return out.drop(*(f"__{c}" for c in TEXT_COLUMNS))
