"""Shortest distances: one source, all pairs, and their orders of emission.

Results are ``(src, dst, dist)``; an unreachable pair is a row with a null distance, which
orders last. All sources are relaxed in the same jobs, keyed by (source, vertex).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import Graph
from quillstone.operators.search import bfs_states
from quillstone.operators.sorting import ranked
from quillstone.runtime import cut, cut_dealt, tasks_for


#: Open pairs that are always relaxed at once, and rounds after which all are.
FEW, NEAREST_ROUNDS = 10_000, 64
#: Vertices a side of a block of the distance matrix.
SIDE = 512
#: Beyond all distances: weights times vertices must stay below half of it.
FAR = 1 << 60


def _all_pairs(graph: Graph, sources: DataFrame, found: DataFrame) -> DataFrame:
    """Found distances, and nulls for the pairs that weren't. The result is n rows a source by
    contract, so the pairing is its own size, not a detour."""
    ids = graph.vertices.select(F.col("id").alias("dst"))
    pairs = sources.select(F.col("id").alias("src")).join(ids, how="cross")
    return pairs.join(found, ["src", "dst"], "left").select("src", "dst", "dist")


def hops(graph: Graph, sources: DataFrame) -> DataFrame:
    """``(src, dst, dist)`` of reachable pairs by number of edges."""
    for met in bfs_states(graph, sources):
        pass
    return met.select(F.col("source").alias("src"), F.col("id").alias("dst"), "dist")


def weighted(graph: Graph, sources: DataFrame, negative: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """``(src, dst, dist)`` of reachable pairs by weight: rounds of relaxation from what improved.

    Arcs lie dealt out by their start, and pairs by their vertex, so a round moves only pairs
    and what reaches them. Of many pairs that improved the nearest are relaxed first, as the others may
    improve again: so most arcs are walked once. Weights are whole numbers; below zero they are
    refused unless ``negative``. A cycle of negative length raises.
    """
    parts = tasks_for(graph.edges)
    arcs = graph.arcs().select("src", "dst", "w").repartition(parts, "src").groupBy("src", "dst").agg(F.min("w").alias("w"))
    arcs = cut_dealt(arcs.filter("src <> dst or w < 0"), "src")
    if arcs.filter("w < 0").limit(1).count() and not negative:
        raise ValueError("negative weights")
    n = graph.vertices.count()
    few = max(FEW, n // 100)
    first = sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("d"), F.lit(True).alias("open"))
    pairs = cut_dealt(first.repartition(parts, "id"), "id")
    for k in range(max_rounds):
        now = pairs.filter("open").agg(F.count("*").alias("n"), F.percentile_approx("d", 0.25, 100).alias("near")).first()
        if not now.n:
            return pairs.select(F.col("source").alias("src"), F.col("id").alias("dst"), F.col("d").alias("dist"))
        if negative and k > n:
            raise ValueError("a cycle of negative length")
        relaxed = F.col("open")
        if not negative and now.n > few and k < NEAREST_ROUNDS:
            relaxed = relaxed & (F.col("d") <= F.lit(now.near))
        step = pairs.filter(relaxed).join(arcs.hint("merge"), F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"), F.lit(True).alias("open"))
        every = pairs.withColumn("open", F.col("open") & ~relaxed).unionByName(step).repartition(parts, "id")
        low = every.groupBy("source", "id").agg(F.min("d").alias("d"), F.min(F.when(~F.col("open"), F.col("d"))).alias("done"))
        pairs = cut_dealt(low.select("source", "id", "d", (F.col("done").isNull() | (F.col("d") < F.col("done"))).alias("open")), "id")
    raise RuntimeError("distances did not settle")


def _found(graph: Graph, sources: DataFrame, is_weighted: bool) -> DataFrame:
    return weighted(graph, sources) if is_weighted else hops(graph, sources)


def single_source(graph: Graph, source: int, is_weighted: bool = False) -> DataFrame:
    """All vertices' distances from one; without rows where it isn't a vertex."""
    start = graph.vertices.filter(F.col("id") == source)
    found = _found(graph, start, is_weighted)
    if not start.limit(1).count():
        return found.limit(0)
    here = F.lit(source).cast(found.schema["src"].dataType).alias("src")
    return graph.vertices.select(F.col("id").alias("dst")).join(found.select("dst", "dist"), "dst", "left").select(here, "dst", "dist")


def _placed(df: DataFrame, *keys: Column | str) -> DataFrame:
    return ranked(df, list(keys), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def enumerate_single_source(graph: Graph, source: int, is_weighted: bool = False) -> DataFrame:
    """``(phase, seq, src, dst, dist)``: by distance, then vertex; unreachable ones last, by vertex."""
    out = _placed(single_source(graph, source, is_weighted), F.col("dist").asc_nulls_last(), "dst")
    return out.select(F.when(F.col("dist").isNull(), "rest").otherwise("search").alias("phase"), "seq", "src", "dst", "dist")


def all_pairs(graph: Graph, is_weighted: bool = False) -> DataFrame:
    return _all_pairs(graph, graph.vertices, _found(graph, graph.vertices, is_weighted))


def _closed(block: np.ndarray) -> np.ndarray:
    """Shortest distances inside a block."""
    block = block.copy()
    for k in range(len(block)):
        np.minimum(block, block[:, k, None] + block[None, k], out=block)
    return block


def _product(out: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``out`` and all ways over the vertices between ``a`` and ``b``."""
    out = out.copy()
    for k in range(len(b)):
        np.minimum(out, a[:, k, None] + b[None, k], out=out)
    return out


BLOCKS = "i int, j int, data binary"


def _blocks(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[tuple]:
    """Rows with binaries as square blocks."""
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield tuple(np.frombuffer(x, np.int64).reshape(side, side) if isinstance(x, bytes) else x for x in row)


def _out(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for i, j, x in rows:
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["i", "j", "data"])


def _filled(side: int):
    """Blocks from cells ``(i, j, cell, dist)`` sorted by block; a cell's place is counted by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for b in batches:
            i, j, cell, dist = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for k in np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(i) else []):
                key = (int(i[k]), int(j[k]))
                if key != held:
                    if held is not None:
                        yield from _out([(*held, block)])
                    held, block = key, np.full(side * side, FAR, np.int64)
                own = (i == key[0]) & (j == key[1])
                block[cell[own]] = dist[own]
        if held is not None:
            yield from _out([(*held, block)])

    return run


def floyd_warshall(graph: Graph) -> DataFrame:
    """All pairs by blocks of the distance matrix; negative weights allowed, parallel edges by the least.

    For each stretch of ``SIDE`` vertices, paths may pass through one more: the stretch's own block
    is closed, then the blocks in its row and column, then every other from those two. So there
    are n / SIDE rounds, each a pass over the matrix's blocks, and a task holds three of them.
    Raises where a vertex lies on a cycle of negative length.
    """
    n = graph.vertices.count()
    size = max(1, min(SIDE, n))
    parts = int(graph.vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = cut(ranked(graph.vertices.select("id"), ["id"], parts, "at").select("id", (F.col("at") - 1).alias("at")))
    zero = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("dist"))
    d = graph.arcs().select("src", "dst", F.col("w").cast("long").alias("dist")).unionByName(zero).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    if d.filter("src = dst and dist < 0").limit(1).count():
        raise ValueError("a cycle of negative length")
    a, b = (ids.select(F.col("id").alias(c), F.col("at").alias(f"{c}_at")) for c in ("src", "dst"))
    block = lambda c: F.floor(F.col(f"{c}_at") / size).cast("int")
    cells = d.join(a, "src").join(b, "dst").select(block("src").alias("i"), block("dst").alias("j"), (F.col("src_at") % size * size + F.col("dst_at") % size).alias("cell"), "dist")
    rows = cut(cells.repartition(parts, "i", "j").sortWithinPartitions("i", "j").mapInArrow(_filled(size), BLOCKS))
    side = -(-n // size)
    # blocks without an edge are there too: paths may lead through them
    spark = graph.vertices.sparkSession
    every = spark.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))
    none = F.lit(np.full(size * size, FAR, np.int64).tobytes()) if side > 1 else F.lit(b"")
    rows = cut(every.join(rows, ["i", "j"], "left").select("i", "j", F.coalesce("data", none).alias("data")))
    for k in range(side):
        own = rows.filter((F.col("i") == k) & (F.col("j") == k)).select(F.col("data").alias("own"))
        # one block, of a fixed size
        with_own = rows.filter((F.col("i") == k) | (F.col("j") == k)).join(F.broadcast(own))

        def cross(batches, k=k):
            for i, j, x, own in _blocks(batches, size):
                c = _closed(own)
                yield from _out([(i, j, c if i == j else _product(x, c, x) if i == k else _product(x, x, c))])

        near = cut(with_own.select("i", "j", "data", "own").mapInArrow(cross, BLOCKS))
        rest = rows.filter((F.col("i") != k) & (F.col("j") != k))
        left = near.filter(F.col("j") == k).select("i", F.col("data").alias("a"))
        right = near.filter(F.col("i") == k).select("j", F.col("data").alias("b"))

        def others(batches):
            yield from _out((i, j, _product(x, a, b)) for i, j, x, a, b in _blocks(batches, size))

        far = rest.join(left, "i").join(right, "j").select("i", "j", "data", "a", "b").mapInArrow(others, BLOCKS)
        rows = cut(near.unionByName(far))

    def found(batches):
        for i, j, x in _blocks(batches, size):
            s, t = np.nonzero(x < FAR // 2)
            yield pa.RecordBatch.from_arrays([pa.array(s + i * size), pa.array(t + j * size), pa.array(x[s, t])], ["src_at", "dst_at", "dist"])

    known = rows.mapInArrow(found, "src_at long, dst_at long, dist long").join(a, "src_at").join(b, "dst_at").select("src", "dst", "dist")
    known = cut(known)
    if known.filter("src = dst and dist < 0").limit(1).count():
        raise ValueError("a cycle of negative length")
    return _all_pairs(graph, graph.vertices, known)


def enumerate_all_pairs(graph: Graph, is_weighted: bool = False) -> DataFrame:
    """``(phase, src, dst, dist)``: first every vertex to itself, then rows by source."""
    rest = all_pairs(graph, is_weighted).filter("src <> dst").select(F.lit("search").alias("phase"), "src", "dst", "dist")
    return graph.vertices.select(F.lit("credit").alias("phase"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("dist")).unionByName(rest)


def enumerate_no_self(graph: Graph, is_weighted: bool = False) -> DataFrame:
    """``(phase, src, dst, dist)`` without pairs of a vertex with itself.

    Credit: vertices without outgoing edges are unreachable from nowhere on, so all their
    rows are null; of others every edge is a distance of 1, or, with weights, the least edge
    is the distance to its end. Loops and parallel edges give nothing twice.
    """
    arcs = graph.arcs().filter("src <> dst")
    every = all_pairs(graph, is_weighted).filter("src <> dst")
    has = arcs.select("src").distinct()
    alone = every.join(has, "src", "left_anti").select("src", "dst", F.lit(None).cast("long").alias("dist"))
    if is_weighted:
        low = arcs.groupBy("src").agg(F.min(F.struct("w", "dst")).alias("m"))
        sure = low.select("src", F.col("m.dst").alias("dst"), F.col("m.w").cast("long").alias("dist"))
    else:
        sure = arcs.select("src", "dst").distinct().withColumn("dist", F.lit(1).cast("long"))
    credit = alone.unionByName(sure)
    rest = every.join(credit.select("src", "dst"), ["src", "dst"], "left_anti")
    return credit.select(F.lit("credit").alias("phase"), "src", "dst", "dist").unionByName(rest.select(F.lit("search").alias("phase"), "src", "dst", "dist"))


def enumerate_sorted(graph: Graph, is_weighted: bool = False) -> DataFrame:
    """``(seq, src, dst, dist)``: all pairs by distance, unreachable ones last; ties by source, then
    vertex."""
    return _placed(all_pairs(graph, is_weighted), F.col("dist").asc_nulls_last(), "src", "dst").select("seq", "src", "dst", "dist")
