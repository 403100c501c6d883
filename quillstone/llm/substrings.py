"""Repeated substrings by distributed prefix doubling over sampled suffixes.

The question: which bytes lie in a string of ``LENGTH`` bytes that also starts earlier, in
a smaller document or further left in the same one? A suffix array answers it by sorting
all positions by rank pairs at doubling offsets until ranks are unique or the threshold
is passed. The rounds here compare 32, then 64, then 100 bytes, and in each only those
positions are sorted that can still matter:

- Every window of ``LENGTH`` bytes is led by its anchor, the gram of the round's length in
  it that has the smallest rank (leftmost of equals). Equal windows have equal anchors at
  equal offsets, so an anchor stands for the run of consecutive windows that it leads: of
  32-byte grams there is one to about 30 positions, of 100-byte grams one to each.
- Spark sorts anchors by the rank of their gram, then by the rank of all bytes that the
  run's windows span, then by place. Where the gram's rank is unique no window of the run
  repeats. Of equal spans all but the first repeat entirely. First runs of a gram with
  several spans stay open, and only their windows enter the next round.

A round's rank is a 64-bit hash of the pair of ranks of the round before, at a position and at
the offset that reaches the gram's end: a name that is the same everywhere, so that renaming
needs no round trip, and open positions alone go on. Runs are taken as equal by 88 bits of two ranks.
Sorted rows are read as a stream that keeps one row: no group of repeats is ever gathered,
of whatever size.

Texts are UTF-8 bytes; null texts are empty; matches don't cross documents. Rows that
repeat both id and text are one document and get one result each. Rows that share an id
but not the text are ordered by a hash of their text. A null id sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.runtime import cut

LENGTH = 100
#: Bytes that the rounds compare; the last is the threshold.
ROUNDS = (32, 64, LENGTH)
#: Windows of one step; longer texts are taken in slices of so many.
SLICE = 1 << 20
_INDEX = np.uint64((1 << 26) - 1)


def _slid(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    step, out = 1, g
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(g) - width + 1], out[width - step : width - step + len(g) - width + 1])


def _ranks(sums: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all grams of a round's length: those of the first round name bytes, every other is
    named by the pair of the ranks, in the round before, at its place and at the offset that
    reaches its end."""
    first = ROUNDS[0]
    rank, reach = tx.mix((sums[first:] - sums[:-first]) * tx.POWERS.get(len(sums))[1][: len(sums) - first]), first
    for longer in ROUNDS[1:]:
        if reach == length:
            break
        offset = longer - reach
        rank, reach = tx.mix(rank[:-offset] * np.uint64(0x9E3779B97F4A7C15) + rank[offset:]), longer
    return rank


def _anchors(texts: list[bytes], gram: int, open_: list[np.ndarray | None]) -> tuple[np.ndarray, ...] | None:
    """Per run of windows: text number, first window, windows, rank of gram, rank of span.

    ``open_`` has for each text which windows count, or None for all.
    """
    buf, at = tx.joined(texts)
    room = np.maximum(np.diff(at) - LENGTH, 0)  # windows of each text
    if not room.sum():
        return None
    sums = tx.prefix_hash(buf)
    g = _ranks(sums, gram)
    least = _slid((g & ~_INDEX) | np.arange(len(g), dtype=np.uint64), LENGTH - gram + 1)
    doc = np.repeat(np.arange(len(texts)), room)
    base = np.concatenate(([0], np.cumsum(room)))
    window = np.arange(len(doc)) - base[doc] + at[doc]
    if any(x is not None for x in open_):
        mask = np.concatenate([np.ones(n, dtype=bool) if x is None else x for x, n in zip(open_, room)])
        doc, window = doc[mask], window[mask]
        if not len(doc):
            return None
    anchor = (least[window] & _INDEX).astype(np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(doc)))
    start, own = window[lead], anchor[lead]
    span = (sums[start + count - 1 + LENGTH] - sums[start]) * tx.POWERS.get(len(buf) + 1)[1][start]
    span = tx.mix(span + tx.mix(((own - start) * 1024 + count).astype(np.uint64)))
    return doc[lead], start - at[doc[lead]], count, g[own], span


def _slices(rows, runs) -> Iterator[tuple[int, int, bytes, np.ndarray | None]]:
    """Document, offset, bytes and open windows; slices overlap so that each window is in one."""
    for k, (i, t) in enumerate(rows):
        mask = None
        if runs is not None:
            open_ = runs(k)
            open_ = open_[open_ & 1 == 0]
            if not len(open_):
                continue
            edge = np.zeros(max(1, len(t) - LENGTH + 1) + 1, dtype=np.int32)
            np.add.at(edge, open_ >> 8, 1)
            np.add.at(edge, (open_ >> 8) + (open_ >> 1 & 127), -1)
            mask = np.cumsum(edge[:-1]) > 0
        for s in range(0, max(1, len(t) - LENGTH + 1), SLICE):
            yield i, s, t[s : s + SLICE + LENGTH - 1], None if mask is None else mask[s : s + SLICE]


def _packed(text: bytes) -> bytes:
    return zstandard.compress(text, 3)


def _unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


def _texts(b: pa.RecordBatch, packed: bool) -> Iterator[tuple[int, bytes]]:
    for i, t in zip(b.column(0).to_pylist(), b.column(1)):
        t = t.as_py() or b""
        yield i, _unpacked(t) if packed else t


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they move once, by document."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(t) for _, t in _texts(b, False)], pa.binary())], ["doc", "text"])


def _list_of(b: pa.RecordBatch, k: int, i: int) -> np.ndarray:
    v = b.column(k)[i].values
    return np.zeros(0, np.int64) if v is None else v.to_numpy(zero_copy_only=False)


def _known(key: np.ndarray, span: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which runs of a buffer follow an equal one, in a smaller document or further left."""
    order = np.lexsort((place, doc, span, key))
    key, span, doc, place = key[order], span[order], doc[order], place[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (span[1:] != span[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    out = np.zeros(len(key), dtype=bool)
    out[order] = (doc != doc[lead]) | (place != place[lead])  # the same row twice is no repeat
    return out


def _emit_anchors(gram: int, packed: bool):
    """Rows of the sort: ``key`` has 48 bits of the gram's rank and 16 of the span's, ``rest`` 24
    more of the span's, one that says the run is known to repeat, 7 of the number of windows
    and 32 of the first window.

    Of equal spans in one buffer only the first competes. The others are known to repeat
    already; they get keys of their own and are dealt out evenly, so that a passage which many
    documents hold fills no task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = (lambda k, b=b: _list_of(b, 2, k)) if packed else None
            if packed:  # only texts with open runs are unpacked
                ids, texts = b.column(0).to_pylist(), b.column(1)
                rows = ((i, _unpacked(texts[k].as_py()) if len(runs(k)) else b"") for k, i in enumerate(ids))
            else:
                rows = _texts(b, False)
            for part in tx.pieces(_slices(rows, runs), lambda x: len(x[2]) + 64, SLICE):
                found = _anchors([x[2] for x in part], gram, [x[3] for x in part])
                if found is None:
                    continue
                doc, start, count, rank, span = found
                ids, offsets = np.array([x[0] for x in part]), np.array([x[1] for x in part])
                key = (rank & np.uint64(0xFFFFFFFFFFFF0000)) | (span >> np.uint64(48))
                place = start + offsets[doc]
                rest = (span << np.uint64(40)) | (count.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
                known = _known(key, span, ids[doc], place)
                key = np.where(known, tx.mix(rest ^ ids[doc].astype(np.uint64)), key)
                rest = rest | (known.astype(np.uint64) << np.uint64(39))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(ids[doc], pa.int64())], ["key", "rest", "doc"])

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by gram, span and place: runs that repeat, and first runs to look into.

    A run is (first window << 8 | windows << 1 | 1 if it repeats). One row is kept between
    batches, and the first run of a gram until a second span of that gram is met.
    """
    last = waiting = None
    for b in batches:
        if not b.num_rows:
            continue
        key, rest, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        run = ((rest & 0xFFFFFFFF) << 8) | ((rest >> 32 & 127) << 1)
        known = (rest >> 39 & 1).astype(bool)
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(run[known] | 1)], ["doc", "run"])
            key, rest, doc, run = key[~known], rest[~known], doc[~known], run[~known]
            if not len(key):
                continue
        lead = (key[0], rest[0], doc[0]) if last is None else last
        k0, r0, d0 = (np.concatenate(([x], y[:-1])) for x, y in zip(lead, (key, rest, doc)))
        new_gram = key >> 16 != k0 >> 16
        if last is None:
            new_gram[0] = True
        new_span = new_gram | (key != k0) | (rest >> 40 != r0 >> 40)
        again = ~new_span & ((doc != d0) | (rest != r0))  # the same row twice is no repeat
        second = new_span & ~new_gram
        group = np.cumsum(new_gram)
        has = np.zeros(group[-1] + 1, dtype=bool)
        has[group[second]] = True
        first = new_gram & has[group]
        docs, runs = [doc[again], doc[second | first]], [run[again] | 1, run[second | first]]
        if waiting is not None and has[0]:
            docs.append(waiting[0:1])
            runs.append(waiting[1:2])
            waiting = None
        if group[-1]:
            k = np.flatnonzero(new_gram)[-1]
            waiting = None if has[-1] else np.array([doc[k], run[k]])
        last = (key[-1], rest[-1], doc[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(runs))], ["doc", "run"])


def _ranked(anchors: DataFrame, n: int) -> DataFrame:
    """One round's sort; runs that repeat or stay open."""
    span, start = F.shiftrightunsigned("rest", 40), F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF))
    dealt = anchors.repartition(n, F.shiftrightunsigned("key", 16))
    return dealt.sortWithinPartitions("key", span, "doc", start).mapInArrow(_repeats, "doc long, run long")


def removed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in a repeated window."""
    edge = np.zeros(n + 1, dtype=np.int32)
    runs = runs[runs & 1 == 1]
    np.add.at(edge, runs >> 8, 1)
    np.add.at(edge, (runs >> 8) + (runs >> 1 & 127) - 1 + LENGTH, -1)
    return np.cumsum(edge[:n]) > 0


def _numbered(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``(doc, text)`` where doc orders documents as their ids do and names one text each, and
    ``(doc, id)`` where these differ."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    ids = docs.agg(F.count("*").alias("n"), F.count(id_col).alias("some"), F.count_distinct(id_col).alias("ids")).first()
    if ids.n == ids.some == ids.ids:
        return rows.select(F.col("id").alias("doc"), "text"), None
    named = rows.select("id", F.xxhash64("text").alias("th")).distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = cut(named.repartitionByRange(n, "id", "th").sortWithinPartitions("id", "th").withColumn("doc", F.monotonically_increasing_id()))
    named = named.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "doc")
    match = F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    return rows.join(named, match).select("doc", "text"), named.select("doc", F.col("__id").alias("id"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text, runs)``: every row's packed text and the runs of windows that repeat."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain, names = _numbered(docs, id_col, text)
    schema = "key long, rest long, doc long"
    first = cut(_ranked(plain.mapInArrow(_emit_anchors(ROUNDS[0], False), schema), n))
    # the packed texts move once: every later round and the end read the same exchange
    rows = plain.mapInArrow(_pack, "doc long, text binary").repartition(n, "doc")

    def joined(runs: DataFrame) -> DataFrame:
        return rows.join(runs.groupBy("doc").agg(F.collect_list("run").alias("runs")), "doc", "left")

    found, repeats = first, [first]
    for gram in ROUNDS[1:]:
        open_ = joined(found.filter(F.col("run").bitwiseAND(F.lit(1)) == 0))
        found = _ranked(open_.select("doc", "text", "runs").mapInArrow(_emit_anchors(gram, True), schema), n)
        repeats.append(found)
    end = None
    for x in repeats:
        x = x.filter(F.col("run").bitwiseAND(F.lit(1)) == 1)
        end = x if end is None else end.unionByName(x)
    out = joined(end)
    if names is None:
        return out.select(F.col("doc").alias("id"), "text", "runs")
    return out.join(names, "doc").select("id", "text", "runs")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Every row without its repeated bytes (see ``RESULT``); ``kept`` is null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.pieces(enumerate(_texts(b, True)), lambda x: len(x[1][1]) + 200):
                out = []
                for i, (doc, t) in part:
                    runs = _list_of(b, 2, i)
                    if len(runs):
                        gone = removed(len(t), runs)
                        left = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    else:
                        left, spans = t, 0
                    out.append((doc, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest(), left if keep else None))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4]), pa.array(cols[5], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeated_runs(docs, id_col, text).mapInArrow(run, RESULT)
