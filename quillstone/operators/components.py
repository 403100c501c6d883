"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star contraction: every node's neighbours are linked to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(low, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def _sum_of(edges: DataFrame) -> tuple:
    h: Column = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, component)`` for every node of ``edges(u, v)``; component is the smallest node.

    Rounds grow with the logarithm of the graph; each is written to the shared
    checkpoint folder, so a lost executor costs one round. Nothing but a count and a
    checksum reaches the driver. Nulls and self-loops link nothing; a self-loop's node
    is still returned. Empty input gives an empty result.
    """
    pairs = edges.select("u", "v").filter("u is not null and v is not null")
    loops = pairs.filter("u = v").select(F.col("u").alias("v"))
    now = cut(
        pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    last = _sum_of(now)
    for _ in range(max_rounds):
        if not last[0]:
            break
        now = cut(_star(_star(now, True), False))
        if (new := _sum_of(now)) == last:
            break
        last = new
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("v"), F.col("v").alias("component"))
    roots = now.select("v").distinct().select("v", F.col("v").alias("component"))
    alone = loops.distinct().join(members.unionByName(roots), "v", "left_anti").select("v", F.col("v").alias("component"))
    return members.unionByName(roots).unionByName(alone)
