"""From external nodes and edges to graphs with dense vertex ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import Graph
from quillstone.operators.sorting import ranked
from quillstone.runtime import cut


def dense_ids(nodes: DataFrame, key: str) -> DataFrame:
    """``(key, id)``: ids 0..n-1 in the order of the keys; see ``sorting.ranked``."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked(nodes.select(key).distinct(), [key], n, "id").select(key, (F.col("id") - 1).alias("id"))


def translate(edges: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``edges(src, dst, ...)`` with dense ids; an end that isn't a node raises."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    a, b = (ids.select(F.col(key).alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    known = lambda c: F.when(F.col(f"{c}_id").isNull(), F.raise_error(F.concat(F.lit("unknown node "), F.col(c).cast("string"))).cast("long")).otherwise(F.col(f"{c}_id"))
    return joined.select(known("src").alias("src"), known("dst").alias("dst"), *rest)


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of ends once."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def undirected_weighted(edges: DataFrame, length: str = "length") -> DataFrame:
    """Each pair of ends and whole length once: parallel edges of other lengths stay."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.floor(length).cast("long").alias("w")).distinct()


def build(nodes: DataFrame, edges: DataFrame, key: str = "key", length: str | None = None) -> tuple[Graph, DataFrame]:
    """An undirected graph over dense ids, and the ids of the nodes."""
    ids = cut(dense_ids(nodes, key))
    moved = translate(edges, ids, key)
    e = undirected(moved) if length is None else undirected_weighted(moved, length)
    return Graph(ids.select("id"), e, directed=False), ids
