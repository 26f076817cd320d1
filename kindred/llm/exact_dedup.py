"""Exact deduplication by a 128-bit content hash with a byte comparison.

Texts are equal when they are identical after ASCII white space is deleted.
The group key is the MD5 of that normalised text *and* the text itself: hash
aggregation places rows by the hash and then compares the bytes, so a
collision makes two groups. Hot groups shrink in the map-side combine, before
the shuffle. Documents then look up their group by two digests (MD5 and
SHA-256), a join without texts whose hot partitions the adaptive planner can
split. Should both digests ever agree for different texts, those documents
take a second join that compares the texts.

Defined results: a null text counts as empty; ties go to the smallest id; a
null id comes after all other ids; rows that repeat id and text form one
group, count each in ``group_size`` and are marked alike. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_SPAN = Decimal(2**65)
_TOP = Decimal(2**63 - 1)


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in _WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _rank(text: Column, id_col: Column) -> Column:
    """One number that is largest for most code points, then smallest id.

    A decimal is a fixed-width aggregation buffer, so the maximum runs in hash
    aggregation; a struct would force a sort of the texts.
    """
    n = F.length(F.coalesce(text, F.lit(""))).cast("decimal(10,0)")
    rest = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - id_col.cast("decimal(20,0)"), F.lit(Decimal(-1)))
    return n * F.lit(_SPAN).cast("decimal(20,0)") + rest.cast("decimal(20,0)")


def _id_of(rank: Column, like: str) -> Column:
    span = F.lit(_SPAN).cast("decimal(20,0)")
    rest = rank % span
    null_id = F.pmod(rank + F.lit(Decimal(1)), span) == 0
    return F.when(null_id, F.lit(None)).otherwise(F.lit(_TOP).cast("decimal(20,0)") - rest).cast(like)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash128: Callable[[Column], Column] = content_hash,
    check: Callable[[Column], Column] = digest,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``hash128`` and ``check`` are parameters so that tests can force
    collisions; results do not depend on them.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"), normalised(F.col(text_col)).alias("_n")
    )
    keyed = base.select("doc_id", "_n", hash128(F.col("_n")).alias("_h"), _rank(F.col("_t"), F.col("doc_id")).alias("_r"))
    by_text = keyed.groupBy("_h", "_n").agg(F.count(F.lit(1)).alias("group_size"), F.max("_r").alias("_r"))
    groups = written(
        by_text.select(
            "_h",
            check(F.col("_n")).alias("_d"),
            F.sha2("_n", 256).alias("text_sha256"),
            "group_size",
            _id_of(F.col("_r"), "long").alias("keep_id"),
        ),
        "exact-groups",
    )
    members = base.select("doc_id", "_n", hash128(F.col("_n")).alias("_h"), check(F.col("_n")).alias("_d"))
    unclear = groups.groupBy("_h", "_d").count().filter("count > 1")
    if unclear.limit(1).count() == 0:
        out = members.drop("_n").join(groups, ["_h", "_d"])
    else:
        unclear = written(unclear.select("_h", "_d"), "exact-unclear")
        clear = groups.join(unclear, ["_h", "_d"], "left_anti")
        texts = by_text.select(
            "_h", check(F.col("_n")).alias("_d"), "_n", F.sha2("_n", 256).alias("text_sha256"), "group_size", _id_of(F.col("_r"), "long").alias("keep_id")
        ).join(unclear, ["_h", "_d"], "left_semi")
        out = members.drop("_n").join(clear, ["_h", "_d"]).unionByName(members.join(texts, ["_h", "_d", "_n"]).drop("_n"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows all stay."""
    keep = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("doc_id"), F.col("text_sha256").alias("sha")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(keep["doc_id"]) & (F.sha2(normalised(docs[text_col]), 256) == keep["sha"])
    return docs.join(keep, same, "left_semi")
