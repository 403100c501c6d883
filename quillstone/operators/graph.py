"""Graphs as two DataFrames, and the algebra on them.

``vertices(id)`` and ``edges(src, dst[, w])``. An undirected graph keeps each edge once;
``arcs()`` gives both directions, a loop once. Every operation is a declarative plan: joins
and aggregates on the edge table, partitioned by its key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT, IN = "out", "in"


def key_of(direction: str) -> tuple[str, str]:
    """Columns that hold the vertex and its other end for a direction."""
    if direction not in (OUT, IN):
        raise ValueError(f"unknown direction {direction!r}")
    return ("src", "dst") if direction == OUT else ("dst", "src")


def other(vertex: Column | int) -> Column:
    """The end of an edge that isn't ``vertex``."""
    v = vertex if isinstance(vertex, Column) else F.lit(vertex)
    return F.when(F.col("src") == v, F.col("dst")).otherwise(F.col("src"))


def canonical(edges: DataFrame) -> DataFrame:
    """Ends in ascending order; other columns stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def same_undirected(a: str, b: str) -> Column:
    """Whether struct columns ``a`` and ``b`` (src, dst) are one undirected edge."""
    x, y = F.col(a), F.col(b)
    ends = lambda e: (F.least(e["src"], e["dst"]), F.greatest(e["src"], e["dst"]))
    return (ends(x)[0] == ends(y)[0]) & (ends(x)[1] == ends(y)[1])


def swapped(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """Vertices default to the ends of edges. Extra columns of ``edges`` are kept."""
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return Graph(vertices.select("id"), edges, directed)

    @staticmethod
    def range(spark, n: int, edges: DataFrame, directed: bool = True) -> Graph:
        return Graph(spark.range(n), edges, directed)

    def arcs(self) -> DataFrame:
        """Edges as they can be walked."""
        if self.directed:
            return self.edges
        # both directions of an edge at once, so that the edges are made once
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ways = F.when(F.col("src") != F.col("dst"), both).otherwise(F.slice(both, 1, 1))
        return self.edges.select(F.explode(ways).alias("__way"), *rest).select("__way.src", "__way.dst", *rest).select(*self.edges.columns)

    def transpose(self) -> Graph:
        return Graph(self.vertices, swapped(self.edges), self.directed)

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def degrees(self, direction: str = OUT) -> DataFrame:
        """``(id, degree)`` of all vertices, those without edges too; undirected loops count once."""
        key, _ = key_of(direction)
        found = self.arcs().groupBy(F.col(key).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def degree(self, vertex: int, direction: str = OUT) -> int:
        return self.adjacencies(vertex, direction).count()

    def neighbors(self, vertex: int, direction: str = OUT) -> DataFrame:
        return self.adjacencies(vertex, direction).select("id")

    def adjacencies(self, vertex: int, direction: str = OUT) -> DataFrame:
        """The other ends and the data of a vertex's edges."""
        key, far = key_of(direction)
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return self.arcs().filter(F.col(key) == vertex).select(F.col(far).alias("id"), *rest)

    def statistics(self) -> DataFrame:
        """One row: sizes, and least, mean and largest degree in both directions."""
        ins, outs = (self.degrees(d).select("id", F.col("degree").alias(d)) for d in (IN, OUT))
        stats = ins.join(outs, "id").agg(
            F.count("*").alias("num_vertices"),
            *[f(F.col(d).cast("double")).alias(f"deg_{d}_{n}") for d in (IN, OUT) for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))],
        )
        size = self.edges.agg(F.count("*").alias("num_edges"))
        return stats.join(F.broadcast(size)).select("num_vertices", "num_edges", *[f"deg_{d}_{n}" for d in (IN, OUT) for n in ("min", "avg", "max")])


def forest_edges(parents: DataFrame) -> DataFrame:
    """Edges child to parent of ``(v, parent[, w])``; roots have a null parent."""
    rest = [c for c in parents.columns if c not in ("v", "parent")]
    return parents.filter("parent is not null").select(F.col("v").alias("src"), F.col("parent").alias("dst"), *rest)


def isolated_forest(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("v"), F.lit(None).cast("long").alias("parent"))


def disjoint_sets(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """``(v, component)``: the partition that uniting all ``pairs(u, v)`` makes of ``elements(id)``.

    The representative is the smallest member, whatever the order of unions.
    """
    from quillstone.operators.components import connected_components

    found = connected_components(pairs)
    return elements.join(found, elements["id"] == found["v"], "left").select(F.col("id").alias("v"), F.coalesce("component", "id").alias("component"))


def sets(partition: DataFrame) -> DataFrame:
    """``(component, members)`` in the order of representatives."""
    return partition.groupBy("component").agg(F.sort_array(F.collect_list("v")).alias("members")).orderBy("component")
