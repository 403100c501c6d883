"""Traversals. Levels are joins on the frontier; orders that depend on adjacency order run as
one grouped function for each graph, since they are sequential by nature."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.components import connected_components
from quillstone.operators.graph import Graph
from quillstone.runtime import cut, cut_dealt, tasks_for

EVENTS = "graph_id long, seq long, kind string, u long, v long"


class HasCycles(ValueError):
    """The graph has no topological order."""


def bfs_states(graph: Graph, sources: DataFrame, max_levels: int | None = None) -> Iterator[DataFrame]:
    """What was met after each level, as ``(source, id, dist)``, from all ``sources(id)`` at once.

    Arcs lie dealt out by their start and stay there; a level moves what was met and what its
    last level leads to. All searches advance in the same job, so the number of jobs is the longest
    distance, not the number of sources.
    """
    parts = tasks_for(graph.edges)
    arcs = cut_dealt(graph.arcs().select("src", "dst").repartition(parts, "src").distinct(), "src")
    start = sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("dist"))
    met, k = cut_dealt(start.repartition(parts, "id"), "id"), 0
    yield met
    while (max_levels is None or k < max_levels) and met.filter(F.col("dist") == k).limit(1).count():
        k += 1
        step = met.filter(F.col("dist") == k - 1).join(arcs.hint("merge"), F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), F.lit(k).cast("long").alias("dist"))
        met = cut_dealt(met.unionByName(step).repartition(parts, "id").groupBy("source", "id").agg(F.min("dist").alias("dist")), "id")
        yield met


def bfs_levels(graph: Graph, sources: DataFrame, max_levels: int | None = None) -> Iterator[DataFrame]:
    """One DataFrame ``(source, id, dist)`` a level; see ``bfs_states``."""
    for k, met in enumerate(bfs_states(graph, sources, max_levels)):
        level = met.filter(F.col("dist") == k)
        if not level.limit(1).count():
            return
        yield level


def reachable(graph: Graph, source: int) -> DataFrame:
    """``(id, dist)`` of what a vertex reaches."""
    for met in bfs_states(graph, graph.vertices.filter(F.col("id") == source)):
        pass
    return met.select("id", "dist")


def is_connected(graph: Graph) -> bool:
    """Whether an undirected graph is of one piece; the empty graph is."""
    edges = graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    comp = connected_components(edges)
    alone = graph.vertices.join(comp, graph.vertices["id"] == comp["v"], "left_anti").count()
    return comp.select("component").distinct().count() + alone <= 1


def reduce_to_component(graph: Graph, source: int) -> Graph:
    """The part of the graph that ``source`` reaches."""
    keep = cut(reachable(graph, source).select("id"))
    ends = graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
    return Graph(keep, ends.join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*graph.edges.columns), graph.directed)


def bfs_events(near: dict[int, list[int]], source: int | None = None) -> Iterator[tuple]:
    """(kind, u, v): a vertex is discovered, reached over a tree edge, finished. Starts at the
    smallest vertex unless told otherwise."""
    if not near:
        return
    source = min(near) if source is None else source
    seen, queue = {source}, deque([source])
    yield "discovered", source, None
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in seen:
                seen.add(v)
                queue.append(v)
                yield "tree", u, v
                yield "discovered", v, None
        yield "finished", u, None


def dfs_events(near: dict[int, list[int]]) -> Iterator[tuple]:
    """(kind, u, v) of a depth-first search that starts anew at each undiscovered vertex, by id."""
    state: dict[int, int] = {}
    for root in sorted(near):
        if root in state:
            continue
        state[root] = 1
        yield "discovered", root, None
        stack = [(root, iter(near[root]))]
        while stack:
            u, rest = stack[-1]
            for v in rest:
                if v not in state:
                    state[v] = 1
                    yield "tree", u, v
                    yield "discovered", v, None
                    stack.append((v, iter(near[v])))
                    break
                if state[v] == 1:
                    yield "back", u, v
            else:
                state[u] = 2
                yield "finished", u, None
                stack.pop()


def source_removal(near: dict[int, list[int]]) -> list[int]:
    """Topological order by removing sources, the last found first; raises on a cycle."""
    need = {v: 0 for v in near}
    for u in near:
        for v in near[u]:
            need[v] += 1
    free, out = [v for v in sorted(near) if not need[v]], []
    while free:
        u = free.pop()
        out.append(u)
        for v in near[u]:
            need[v] -= 1
            if not need[v]:
                free.append(v)
    if len(out) < len(near):
        raise HasCycles("the graph has a cycle")
    return out


def finish_order(near: dict[int, list[int]]) -> list[int]:
    """Topological order by reversed finishing times; raises at the first back edge."""
    out = []
    for kind, u, _ in dfs_events(near):
        if kind == "back":
            raise HasCycles("the graph has a cycle")
        if kind == "finished":
            out.append(u)
    return out[::-1]


def _grouped(graphs: DataFrame, arcs: DataFrame, body, schema: str) -> DataFrame:
    """Run ``body(near)`` for every graph of ``graphs(graph_id, id)`` and ``arcs(graph_id, src, dst, adj)``.

    Vertices and edges are dealt out and sorted by graph, and a task reads them as a stream:
    one graph is held at a time, and many small ones cost no call each.
    """
    n = tasks_for(graphs, arcs)
    v = graphs.select("graph_id", F.lit(0).alias("part"), F.col("id").alias("adj"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
    e = arcs.select("graph_id", F.lit(1).alias("part"), F.col("adj").cast("long").alias("adj"), "src", "dst")
    rows = v.unionByName(e).repartition(n, "graph_id").sortWithinPartitions("graph_id", "part", "adj").select("graph_id", "src", "dst")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        graph, near, out = None, {}, []

        def batch():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for b in batches:
            for g, src, dst in zip(*(b.column(i).to_pylist() for i in range(3))):
                if g != graph:
                    if near:
                        out.extend((graph, *r) for r in body(near))
                        if len(out) >= 10_000:
                            yield batch()
                    graph, near = g, {}
                if dst is None:
                    near[src] = []
                else:
                    near[src].append(dst)
        if near:
            out.extend((graph, *r) for r in body(near))
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)


def dfs(graphs: DataFrame, arcs: DataFrame) -> DataFrame:
    """Events of a depth-first search of each graph (see ``EVENTS``)."""
    return _grouped(graphs, arcs, lambda near: ((i, *x) for i, x in enumerate(dfs_events(near))), EVENTS)


def bfs(graphs: DataFrame, arcs: DataFrame, source: int | None = None) -> DataFrame:
    return _grouped(graphs, arcs, lambda near: ((i, *x) for i, x in enumerate(bfs_events(near, source))), EVENTS)


def dfs_forest(graphs: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(graph_id, v, parent)`` from the tree edges of the search."""

    def parents(near):
        """Each vertex where it is discovered, after the edge that led there."""
        led = None
        for kind, u, v in dfs_events(near):
            if kind == "discovered":
                yield u, led
            led = u if kind == "tree" else None

    return _grouped(graphs, arcs, parents, "graph_id long, v long, parent long")


def topological_order(graphs: DataFrame, arcs: DataFrame, method: str = "sources") -> DataFrame:
    """``(graph_id, seq, v)``; method ``sources`` removes sources, ``finish`` reverses finishing times."""
    order = {"sources": source_removal, "finish": finish_order}[method]
    return _grouped(graphs, arcs, lambda near: enumerate(order(near)), "graph_id long, seq long, v long")


def topological_levels(graph: Graph) -> DataFrame:
    """``(id, level)``: length of the longest path to each vertex; raises on a cycle.

    Each round peels all vertices without open predecessors at once, in joins."""
    left, edges, level, out = cut(graph.vertices), cut(graph.edges.select("src", "dst")), 0, []
    n, done = left.count(), 0
    while done < n:
        blocked = edges.select(F.col("dst").alias("id")).distinct()
        free = cut(left.join(blocked, "id", "left_anti"))
        k = free.count()
        if not k:
            raise HasCycles("the graph has a cycle")
        out.append(free.withColumn("level", F.lit(level).cast("long")))
        left = cut(left.join(free, "id", "left_anti"))
        edges = cut(edges.join(free, edges["src"] == free["id"], "left_anti"))
        level, done = level + 1, done + k
    whole = out[0] if out else graph.vertices.withColumn("level", F.lit(0).cast("long"))
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
