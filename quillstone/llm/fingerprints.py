"""Document fingerprints: one-permutation MinHash, densified, packed, bias-corrected.

Every shingle is hashed once; its top bits choose a bin and the rest compete for the
bin's minimum. An empty bin copies the bin that a fixed hash of (bin, attempt) names,
trying on until one that was filled by a shingle (optimal densification). Of each bin
the low ``BITS`` bits are kept, packed. Two unlike bins agree by chance with probability
2**-BITS, which ``likeness`` subtracts.

Shingles are five words, as written. A text of fewer words has its whole sequence as one
shingle. Texts without words (null, empty, blank) share the all-zero fingerprint: they
are alike to each other (1) and to nothing else (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import text as tx

BINS = 512
BITS = 4
SHINGLE = 5
LEAST = -(1 << 63)


def _bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of every bin (texts by bins), and which texts have words."""
    h, doc = tx.shingle_hashes(texts, SHINGLE)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(len(texts) * BINS, none, dtype=np.uint64)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    np.minimum.at(low, doc * BINS + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    full = low != none
    some = full.reshape(-1, BINS).any(axis=1)
    empty = np.flatnonzero(~full & np.repeat(some, BINS))
    attempt = 0
    while len(empty):
        attempt += 1
        rows, b = np.divmod(empty, BINS)
        if attempt <= 16 * BINS:
            at = rows * BINS + (tx.mix((b + BINS * attempt).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        else:  # practically never: the next filled bin in a circle
            at = rows * BINS + (b + attempt) % BINS
        hit = full[at]
        low[empty[hit]] = low[at[hit]]
        empty = empty[~hit]
    out = (tx.mix(low) & np.uint64((1 << BITS) - 1)).astype(np.uint8).reshape(-1, BINS)
    out[~some] = 0
    return out, some




def packed(bins: np.ndarray) -> list[bytes]:
    bits = np.unpackbits(bins[:, :, None], axis=2, bitorder="little")[:, :, :BITS]
    return [x.tobytes() for x in np.packbits(bits.reshape(len(bins), -1), axis=1, bitorder="little")]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of shingle sets, chance agreement of low bits taken off."""
    chance = 2.0**-BITS
    same = (a == b).mean(axis=1)
    est = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, est, np.where(some_a == some_b, 1.0, 0.0))


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint binary)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1))
            for part in tx.pieces(((i, t.as_py() or b"") for i, t in rows), lambda x: len(x[1]) + 2048):
                bins, _ = _bins([t for _, t in part])
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(packed(bins), pa.binary())], ["doc_id", "fingerprint"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, fingerprint binary")


def homes_of(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` tasks a number that Spark's hash partitioning deals to it: numbers of ranges
    themselves collide, so that some tasks would get several ranges and others none."""
    enough = int(n * (np.log(n + 1) + 12))
    found = spark.range(enough).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("task")).agg(F.min("id").alias("id"))
    at = {r["task"]: r["id"] for r in found.collect()}
    return [at[k] for k in range(n)]


def ordered_ranges(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(bucket, ghost, key, id, text)``: rows in ranges of the id, sorted, every range led by
    the row just before it, and the first range by the last row of all.

    The driver gets one cut point and one largest id for each range, never rows. A null id
    sorts before all others.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    ids = docs.select(key.alias("key"))
    cuts = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(k):
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="left").astype(np.int32))

    tops = {r.b: r.top for r in ids.groupBy(range_of("key").alias("b")).agg(F.max("key").alias("top")).collect()}
    order, home = sorted(tops), homes_of(spark, n)
    # the last row of each range also leads the range that follows, in a circle
    led = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def homes(k):
        own = np.searchsorted(cuts, k.to_numpy(), side="left").tolist()
        return pd.Series([[b, led[x]] if x in led else [b] for b, x in zip(own, k.tolist())])

    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.select("key", "id", "text", F.posexplode(homes("key")).alias("ghost", "bucket"))
    dealt = dealt.withColumn("home", F.get(F.lit(home), F.col("bucket") % n))
    return dealt.repartition(n, "home").sortWithinPartitions("bucket", F.col("ghost").desc(), "key", "text")


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None  # bucket, text, bins, some of the row before
    for b in batches:
        rows = zip(*[b.column(i).to_pylist() for i in (0, 1, 2)], b.column(3))
        for part in tx.pieces(((k, g, i, t.as_py()) for k, g, i, t in rows), lambda x: len(x[3]) + 1024, 1 << 20):
            own = [x[3].encode() for x in part]
            edited = []
            last = before
            for k, ghost, i, t in part:
                if ghost:
                    edited.append(None)
                else:
                    if last is None or last[0] != k:
                        raise RuntimeError("a range isn't led by the row before it")
                    h = len(t) // 2
                    edited.append((t[: len(t) - h] + last[1][:h]).encode())
                last = (k, t)
            real = [j for j, e in enumerate(edited) if e is not None]
            bins, some = _bins(own + [edited[j] for j in real])
            mine, mine_some, ed, ed_some = bins[: len(own)], some[: len(own)], bins[len(own) :], some[len(own) :]
            lead = (mine[:1], mine_some[:1]) if before is None else (before[2][None], np.array([before[3]]))
            prev, prev_some = np.concatenate([lead[0], mine[:-1]])[real], np.concatenate([lead[1], mine_some[:-1]])[real]
            before = (part[-1][0], part[-1][3], mine[-1], mine_some[-1])
            if not real:
                continue
            a, a_some = mine[real], mine_some[real]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part[j][2] for j in real], pa.int64()),
                    pa.array([len(part[j][3]) for j in real], pa.int64()),
                    pa.array([hashlib.sha256(edited[j]).hexdigest() for j in real]),
                    pa.array([x.hex() for x in packed(a)]),
                    pa.array([x.hex() for x in packed(ed)]),
                    pa.array(likeness(a, ed, a_some, ed_some)),
                    pa.array(likeness(a, prev, a_some, prev_some)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint against its edited text's and the next row's, by descending id.

    The edited text has its last half (rounded down, in code points) replaced by as many
    first code points of the next row's text, or all it has. After the smallest id comes
    the largest; a single row follows itself. Rows that share an id follow each other by
    descending text. An empty table gives an empty result.
    """
    ranges = ordered_ranges(docs, id_col, text)
    return ranges.select("bucket", "ghost", "id", "text").mapInArrow(_pairs, SCHEMA)
