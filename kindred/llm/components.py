"""Connected components as alternating star contractions over DataFrames.

The edge list stays distributed. Each round points every node's larger
neighbours at its smallest one (large star), then its smaller neighbours
(small star); the number of rounds grows with the logarithm of the longest
path. A hub with a third of all edges is dealt out by a salt, its minimum is
pre-aggregated map-side, and each round is cut by a written table, so that a
lost executor costs one round's tasks. Hubs are nodes with over 1/512 of all
edges (and ``HUB`` at least), so there are 1024 of them at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SALTS, HUB = 64, 10_000


def _with_minimum(edges: DataFrame, candidates: DataFrame, hub: int) -> DataFrame:
    """edges (u, v) with ``m``, the least of u and its candidates' v."""
    least = candidates.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    salts = F.array(*(F.lit(i) for i in range(SALTS)))
    # At most 1024 rows, see above.
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", F.lit(True).alias("hub")))
    some = least.select("u", "m", F.explode(F.when(F.col("n") > hub, salts).otherwise(F.array(F.lit(0)))).alias("s"))
    dealt = edges.join(hubs, "u", "left").withColumn("s", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    return dealt.join(some, ["u", "s"], "left").select("u", "v", F.least("u", F.coalesce("m", "u")).alias("m"))


def large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both, both, hub).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_minimum(down, down, hub)
    to_least = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(linked.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either the end of one edge or only a centre: then nothing is left to contract."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("centre"))
    both = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
    roles = both.groupBy("node").agg(F.sum("end").alias("end"), F.max("centre").alias("centre"))
    return roles.filter("end > 1 or (end = 1 and centre = 1)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an undirected edge list (u, v).

    The component is its smallest node. Nodes without an edge don't appear;
    null ends and loops are ignored. Edges that are stars already, as those of
    a spanning forest of close copies are, take no round at all.
    """
    now = written(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    for _ in range(max_rounds):
        if _stars(now):
            break
        hub = max(HUB, now.count() // 512)
        now = written(small_star(large_star(now, hub), hub), name)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
