"""Chat formatting with collapse of cumulative snapshots.

Loggers often store a conversation again after each turn. Each turn gets a
128-bit hash of its position, role and text, as four 32-bit numbers; their
running sums are rolling hashes of every turn prefix. A conversation whose
last prefix hash is an inner prefix hash of another one is a snapshot of it
and an anti-join removes it; of equal conversations the smallest id stays.
Only then the maximal conversations are rendered.

Both sides of the anti-join are made distinct by a map-side combine, so a
first turn that a third of all conversations share is one row per task.

A conversation is one row of the result, so the turns of one are ordered and
rendered in one task; sorting spills.

Defined results: a null role or text counts as empty; null turns come first;
turns with the same number are ordered by role, then text; repeated rows are
repeated turns; rows without conversation id are left out; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_PARTS = ("_p0", "_p1", "_p2", "_p3")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos from 1, n, role, text, and the rolling hash up to each turn."""
    t = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    t = t.select("conv_id", F.row_number().over(ordered).alias("pos"), F.count(F.lit(1)).over(whole).alias("n"), "role", "text")
    code = F.md5(F.concat_ws("\x1f", F.col("pos").cast("string"), F.length("role").cast("string"), "role", "text"))
    t = t.withColumn("_m", code)
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return t.select(
        "conv_id", "pos", "n", "role", "text",
        *(F.sum(F.conv(F.substring("_m", 1 + 8 * i, 8), 16, 10).cast("long")).over(so_far).alias(p) for i, p in enumerate(_PARTS)),
    )


def maximal(t: DataFrame) -> DataFrame:
    """conv_id and number of equal copies of the conversations that no other one continues."""
    ends = t.filter("pos = n").groupBy("pos", *_PARTS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = t.filter("pos < n").select("pos", *_PARTS).distinct()
    return ends.join(inner, ["pos", *_PARTS], "left_anti").select("conv_id", "n_copies")


def format_chats(conversations: DataFrame, open_tag: str = "<|", close_tag: str = "|>\n", end: str = "\n") -> DataFrame:
    """conv_id, n_turns, n_copies, chat: one row per maximal conversation."""
    hashed = written(turns(conversations), "turns")  # read three times below
    keep = maximal(hashed)
    plain = hashed.select("conv_id", "pos", "role", "text")
    rendered = plain.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("_t"))
    line = lambda t: F.concat(F.lit(open_tag), t["role"], F.lit(close_tag), t["text"], F.lit(end))
    return rendered.join(keep, "conv_id").select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("_t", line), "").alias("chat"))
