"""Minimum spanning forests by rounds of the cheapest crossing edge, and their orders.

Edges are ``(src, dst, w)``; the key (weight, ends) makes every edge distinct, so all
methods agree on one forest. ``order_by`` takes other keys, such as descending weight.
Graphs in several pieces give a spanning forest; the empty graph gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.components import connected_components
from quillstone.operators.graph import Graph
from quillstone.operators.sorting import ranked
from quillstone.runtime import cut


def _keyed(graph: Graph, order_by: list[Column] | None) -> DataFrame:
    ends = [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")]
    e = graph.edges.filter("src <> dst").select(*ends, "w")
    keys = order_by or [F.col("w")]
    return e.select("u", "v", "w", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "u", "v").alias("key"))


def spanning_forest(graph: Graph, order_by: list[Column] | None = None, start: DataFrame | None = None) -> DataFrame:
    """``(round, u, v, w)`` with u < v: every round adds each component's least crossing edge.

    The number of components at least halves in a round, and edges inside one are dropped,
    so rounds are few and shrink. ``start(x, comp)`` names components to begin with.
    """
    edges = cut(_keyed(graph, order_by))
    part = start or graph.vertices.select(F.col("id").alias("x"), F.col("id").alias("comp"))
    part = cut(part)
    rounds: list[DataFrame] = []
    while True:
        a, b = (part.select(F.col("x").alias(c), F.col("comp").alias(f"c{c}")) for c in "uv")
        crossing = edges.join(a, "u").join(b, "v").filter("cu <> cv")
        if rounds:
            crossing = cut(crossing)
            edges = crossing.select(*edges.columns)
        ways = crossing.select(F.col("cu").alias("c"), "key", "u", "v", "w").unionByName(crossing.select(F.col("cv").alias("c"), "key", "u", "v", "w"))
        pick = ways.groupBy("c").agg(F.min_by(F.struct("u", "v", "w"), "key").alias("e")).select("e.*").distinct()
        pick = cut(pick.withColumn("round", F.lit(len(rounds)).cast("long")))
        if not pick.limit(1).count():
            break
        rounds.append(pick)
        joins = pick.join(a, "u").join(b, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        merged = connected_components(joins).select(F.col("v").alias("comp"), "component")
        part = cut(part.join(merged, "comp", "left").select("x", F.coalesce("component", "comp").alias("comp")))
    out = graph.edges.sparkSession.createDataFrame([], pick.schema).select("round", "u", "v", "w") if not rounds else None
    for r in rounds:
        r = r.select("round", "u", "v", "w")
        out = r if out is None else out.unionByName(r)
    return out


def kruskal_order(forest: DataFrame) -> DataFrame:
    """``(seq, u, v, w)``: the forest's edges by weight, as they would be accepted."""
    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked(forest.select("u", "v", "w"), ["w", "u", "v"], parts).select("seq", "u", "v", "w")


def prim_order(forest: DataFrame) -> DataFrame:
    """``(component, seq, v, parent, w)``: edges in the order of attaching to the smallest vertex.

    Only the forest is replayed, one component a task: with distinct keys the next edge to
    attach always is an edge of the forest.
    """
    comp = connected_components(forest.select("u", "v"))
    rows = forest.join(comp, "v").select("component", "u", "v", "w")

    def run(key, e: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        for u, v, w in zip(e["u"], e["v"], e["w"]):
            near.setdefault(u, []).append((w, u, v, v))
            near.setdefault(v, []).append((w, u, v, u))
        start = key[0]
        seen, heap, out = {start}, [(*x[:3], x[3], start) for x in near.get(start, [])], []
        heapq.heapify(heap)
        while heap:
            w, _, _, v, parent = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            out.append((start, len(out) + 1, v, parent, w))
            for x in near[v]:
                heapq.heappush(heap, (*x[:3], x[3], v))
        return pd.DataFrame(out, columns=["component", "seq", "v", "parent", "w"])

    return rows.groupBy("component").applyInPandas(run, "component long, seq long, v long, parent long, w long")


def credit_edges(graph: Graph) -> DataFrame:
    """``(u, v, w)``: each vertex's least edge (ties to the smaller neighbour), once. All are in the
    forest when the key breaks ties alike from both ends; see ``enumerate_forest``."""
    e = _keyed(graph, None)
    ways = e.select(F.col("u").alias("x"), "key", "u", "v", "w").unionByName(e.select(F.col("v").alias("x"), "key", "u", "v", "w"))
    return ways.groupBy("x").agg(F.min_by(F.struct("u", "v", "w"), "key").alias("e")).select("e.*").distinct()


def kruskal_by_parts(graph: Graph, order_by: list[Column] | None = None) -> DataFrame:
    """``(u, v, w)``: Kruskal's method on every part of the edges, then on what the parts keep.

    An edge that isn't in the forest of its part is in no forest of the whole, so parts shrink to
    one edge a vertex and are joined four to one until one is left. A task holds the vertices of
    its part; for graphs whose vertices don't fit in one, use ``spanning_forest``.
    """
    rows = _keyed(graph, order_by)
    schema = rows.schema
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = rows.repartition(parts, "u", "v").sortWithinPartitions("key") if parts > 1 else rows.coalesce(1).sortWithinPartitions("key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := above.get(x, x)) != x:
                    above[x] = x = above.get(up, up)
                return x

            for b in batches:
                keep = []
                for i, (u, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    u, v = root(u), root(v)
                    if u != v:
                        above[u] = v
                        keep.append(i)
                yield b.take(pa.array(keep, pa.int64()))

        rows = cut(dealt.mapInArrow(run, schema))
        if parts == 1:
            return rows.select("u", "v", "w")
        parts = max(1, parts // 4)


def prim_forest(graph: Graph) -> DataFrame:
    """``(u, v, w)`` by attaching the nearest vertex; a component is held by one task."""
    e = _keyed(graph, None).select("u", "v", "w")
    return prim_order(e).select(F.least("parent", "v").alias("u"), F.greatest("parent", "v").alias("v"), "w")


def extension(graph: Graph, chosen: DataFrame, solver: Callable[[Graph], DataFrame] | None = None) -> DataFrame:
    """``(u, v, w)``: what makes the acyclic edges ``chosen(u, v, w)`` a spanning forest, the least of
    all that contain them.

    Without a solver the rounds begin with the components of ``chosen``. A solver, any function
    from a graph to its forest ``(u, v, w)``, gets the graph with every component as one vertex
    and of parallel edges the least, so it need not know of the choice.
    """
    comp = connected_components(chosen.select("u", "v")).select(F.col("v").alias("x"), F.col("component").alias("comp"))
    part = cut(graph.vertices.join(comp, graph.vertices["id"] == comp["x"], "left").select(F.col("id").alias("x"), F.coalesce("comp", "id").alias("comp")))
    if solver is None:
        return spanning_forest(graph, None, part).select("u", "v", "w")
    a, b = (part.select(F.col("x").alias(c), F.col("comp").alias(f"c{c}")) for c in "uv")
    moved = _keyed(graph, None).join(a, "u").join(b, "v").filter("cu <> cv")
    moved = moved.select(F.least("cu", "cv").alias("src"), F.greatest("cu", "cv").alias("dst"), "w", F.struct("u", "v", "w").alias("edge"), "key")
    # the place in the order of keys is the weight, so that the solver breaks no ties of its own
    n = int(moved.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = moved.groupBy("src", "dst").agg(F.min_by(F.struct("edge", "key"), "key").alias("m")).select("src", "dst", "m.edge", "m.key")
    least = cut(ranked(least, ["key"], n, "w").select("src", "dst", "w", "edge"))
    small = Graph(part.select(F.col("comp").alias("id")).distinct(), least.select("src", "dst", "w"), directed=False)
    found = solver(small).select("w")
    return least.join(found, "w").select("edge.*")


def enumerate_forest(graph: Graph, solver: Callable[[Graph], DataFrame] | None = None) -> DataFrame:
    """``(phase, u, v, w)``: credit edges first, found in one aggregate; then their ``extension``."""
    credit = cut(credit_edges(graph))
    rest = extension(graph, credit, solver)
    return credit.select(F.lit("credit").alias("phase"), "u", "v", "w").unionByName(rest.select(F.lit("search").alias("phase"), "u", "v", "w"))
