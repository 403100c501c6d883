"""Seeded instances as DataFrames: random graphs, jobs, arrays and access logs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.graph import Graph
from quillstone.operators.search import is_connected

# The multiplicative generator of published scheduling benchmarks.
MULTIPLIER, MODULUS, FALLBACK_SEED = 16807, 2**31 - 1, 0xBAD


def lcg_state(seed: int) -> int:
    """A usable state: 0 and the modulus are states that never move, and become the fallback."""
    return seed % MODULUS or FALLBACK_SEED


def lcg_draws(spark: SparkSession, seed: int, n: int, low: int, high: int) -> DataFrame:
    """``(k, value)`` of draws 1..n, in low..high.

    Draw k is seed * 16807**k mod (2**31 - 1): tasks jump ahead to their first draw, so
    draws are made side by side and equal the sequential ones.
    """
    start, width = lcg_state(seed), high - low + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            x = np.empty(len(k), dtype=np.int64)
            if len(k):
                # powers by squaring, for all draws at once; products stay below 2**62
                base, e = MULTIPLIER, k.astype(np.int64).copy()
                x[:] = start
                while e.any():
                    odd = (e & 1).astype(bool)
                    x[odd] = x[odd] * base % MODULUS
                    base, e = base * base % MODULUS, e >> 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low + np.floor(x / MODULUS * width).astype(np.int64))], ["k", "value"])

    return spark.range(1, n + 1).select(F.col("id").alias("k")).mapInArrow(run, "k long, value long")


def _check_p(p: float) -> None:
    if not 0 <= p <= 1:
        raise ValueError("a probability lies in [0, 1]")


def sorted_dag(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """``(src, dst)`` with src < dst, each pair with probability p.

    Every vertex skips geometrically over its later ones, so the work is the number of
    edges, not of pairs.
    """
    _check_p(p)

    def run(batches):
        for b in batches:
            src, dst = [], []
            for u in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, u])
                left = n - 1 - u
                if p <= 0 or left <= 0:
                    continue
                if p >= 1:
                    hit = np.arange(u + 1, n)
                else:
                    size = int(left * p + 6 * math.sqrt(left * p) + 16)
                    at = u + np.cumsum(rng.geometric(p, size))
                    while at[-1] < n:
                        at = np.concatenate([at, at[-1] + np.cumsum(rng.geometric(p, size))])
                    hit = at[at < n]
                src.append(np.full(len(hit), u))
                dst.append(hit)
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([join(src), join(dst)], ["src", "dst"])

    return spark.range(n).mapInArrow(run, "src long, dst long")


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``(id, to)``: a random one-to-one map of 0..n-1."""
    from quillstone.operators.sorting import ranked

    drawn = spark.range(n).withColumn("r", F.xxhash64(F.lit(seed), "id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranked(drawn, ["r", "id"], parts, "to").select("id", (F.col("to") - 1).alias("to"))


def dag(spark: SparkSession, n: int, p: float, seed: int) -> Graph:
    """A random acyclic graph whose ids don't show its order."""
    to = permutation(spark, n, seed)
    a, b = (to.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in ("src", "dst"))
    moved = sorted_dag(spark, n, p, seed).join(a, "src").join(b, "dst")
    return Graph.range(spark, n, moved.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")))


def undirected(spark: SparkSession, n: int, p: float, seed: int, weights: tuple[int, int] | None = None) -> Graph:
    """G(n, p); the direction in which an edge is written is a coin's."""
    e = sorted_dag(spark, n, p, seed)
    coin = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(2)) == 0
    cols = [F.when(coin, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(coin, F.col("dst")).otherwise(F.col("src")).alias("dst")]
    if weights:
        low, high = weights
        cols.append((F.lit(low) + F.pmod(F.xxhash64(F.lit(seed + 1), "src", "dst"), F.lit(high - low + 1))).cast("long").alias("w"))
    return Graph.range(spark, n, e.select(*cols), directed=False)


def connected(spark: SparkSession, n: int, p: float, seed: int, tries: int = 100, weights: tuple[int, int] | None = None) -> Graph:
    """The first connected graph of derived seeds."""
    for k in range(tries):
        g = undirected(spark, n, p, seed + 7919 * k, weights)
        if is_connected(g):
            return g
    raise ValueError("no connected graph was drawn")


def clique_and_path(spark: SparkSession, k: int) -> Graph:
    """A clique of k vertices without its last edge, and a path of k*k more that closes the gap."""
    n = k * k + k
    ids = spark.range(k)
    clique = ids.select(F.col("id").alias("src")).join(ids.select(F.col("id").alias("dst")), F.col("src") < F.col("dst"))
    clique = clique.filter(~((F.col("src") == k - 2) & (F.col("dst") == k - 1)))
    path = spark.range(k - 1, n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    close = spark.range(1).select(F.lit(n - 1).cast("long").alias("src"), F.lit(k - 2).cast("long").alias("dst"))
    return Graph.range(spark, n, clique.unionByName(path).unionByName(close), directed=False)


def flow_shop(spark: SparkSession, jobs: int, machines: int, seed: int) -> DataFrame:
    """``(job, machine, p)`` in 1..99, drawn machine by machine."""
    return lcg_draws(spark, seed, jobs * machines, 1, 99).select(
        ((F.col("k") - 1) % jobs).alias("job"), F.floor((F.col("k") - 1) / jobs).alias("machine"), F.col("value").alias("p")
    )


def uniform(low: int, high: int, seed: int, *keys: Column | str) -> Column:
    """A whole number in low..high from the hash of keys: the same in any partitioning."""
    return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(high - low + 1))).cast("long")


def parallel_machines(spark: SparkSession, jobs: int, machines: int, seed: int, high: int | None = None) -> DataFrame:
    """``(job, p, machines)`` with p in 1..high, by default jobs over machines."""
    top = high or max(1, jobs // machines)
    return spark.range(jobs).select(F.col("id").alias("job"), uniform(1, top, seed, "id").alias("p"), F.lit(machines).alias("machines"))


def release_times(spark: SparkSession, jobs: int, seed: int, spread: float) -> DataFrame:
    """``(job, p, r)``: times of the benchmark generator, releases in 0..floor(sum of p * spread)."""
    p = flow_shop(spark, jobs, 1, seed).select("job", "p")
    top = p.agg(F.least(F.floor(F.sum("p") * spread), F.lit(2**31 - 1)).alias("top"))
    return p.join(F.broadcast(top)).select("job", "p", (F.pmod(F.xxhash64(F.lit(seed), "job"), F.col("top") + 1)).alias("r"))


def precedences(spark: SparkSession, jobs: int, seed: int, p: float) -> tuple[DataFrame, Graph]:
    """``(job, p)`` and an acyclic graph over the jobs."""
    return flow_shop(spark, jobs, 1, seed).select("job", "p"), dag(spark, jobs, p, seed)


def elements(spark: SparkSession, n: int, seed: int, high: int = 2**32 - 1) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), uniform(0, high, seed, "id").alias("value"))


def access_log(spark: SparkSession, operations: int, size: int, seed: int) -> DataFrame:
    """``(op_seq, op, index, value)``: reads and writes of uniform places, half each."""
    is_read = uniform(0, 1, seed, "id") == 0
    return spark.range(operations).select(
        F.col("id").alias("op_seq"), F.when(is_read, "read").otherwise("write").alias("op"), uniform(0, size - 1, seed + 1, "id").alias("index"), F.when(~is_read, uniform(0, 10**6, seed + 2, "id")).alias("value")
    )
