"""SimHash near-duplicates, searched through pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (pivots) are its
coordinates, worked out once for each distinct fingerprint. By the triangle inequality two
fingerprints within ``radius`` bits differ by at most ``radius`` in each coordinate, so a
pair is discarded by its maximum coordinate difference and only survivors are compared bit
by bit. A table alone prunes but doesn't part the rows; the pairs to look at come from groups:

- ``near_duplicates`` links fingerprints of 64 bits at ``RADIUS`` or fewer differing bits.
  Of five blocks of bits at least two are equal when three bits differ (ten groups for each
  fingerprint), and both fall into a common cell of the first pivot's distance, so no link is
  lost.
- ``drop_near_duplicates`` links texts whose sets of five-word shingles have a similarity
  (intersection over union) of ``SIMILARITY`` or more. Their fingerprints have 1,024 bits,
  which tell a similarity to about 0.02; groups are bands of minimum hashes, which two texts
  at the threshold miss with a chance of 0.002; survivors of the pivots and of the bits are
  verified on their shingles.

Inside a group rows are sorted by the first pivot's distance and compared within a sliding
window of it, so a task holds a window of a group. A pair whose rows are joined already isn't
compared, and a window whose rows are all joined is left, so a group of thousands of copies
costs what its rows do. Copies count once: only distinct fingerprints or texts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.operators.components import connected_components
from quillstone.runtime import cut

SEED = 42
RADIUS = 3
BLOCKS = (13, 13, 13, 13, 12)
CELL = 8
N_PIVOTS = 16


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, spread by hashing their number."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), seed=SEED) for i in range(n)], dtype=np.uint64)


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """64-bit SimHash of UTF-8 ``text``: lower-cased A-Z, shingles of words with repeats."""
    w = text.lower().split()
    if not w:
        return 0
    votes, n, x = np.zeros(64, dtype=np.int64), max(1, len(w) - words_each + 1), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        part = w[at : at + (1 << 15) + words_each - 1]
        if len(part) <= words_each:
            hashes = [x(b" ".join(part), SEED)]
        else:
            hashes = [x(b" ".join(s), SEED) for s in zip(*[part[k:] for k in range(words_each)])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; null texts count as empty (fingerprint zero)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return src.mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks() -> list[int]:
    ends = np.cumsum((0, *BLOCKS))
    block = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(ends, ends[1:])]
    keep = len(BLOCKS) - RADIUS
    return [sum(block[i] for i in c) for c in combinations(range(len(BLOCKS)), keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _coordinates(fp: np.ndarray, piv: np.ndarray) -> np.ndarray:
    """Distances (pivot, row) of fingerprints of one or more words of 64 bits."""
    return np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.uint16) for p in piv])


def _bytes_of(x: np.ndarray) -> pa.Array:
    """Rows of a C-ordered array as binaries."""
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _rows_of(col: pa.Array, dtype, width: int) -> np.ndarray:
    data = b"".join(col.to_pylist())
    return np.frombuffer(data, dtype=dtype).reshape(-1, width)


def _with_coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piv = pivots()[:, None]
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
        table = _coordinates(fp, piv).astype(np.uint8).T
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(table[:, 0].astype(np.int32)), _bytes_of(table)], ["fp", "d", "table"])


def _grouped(fps: DataFrame) -> DataFrame:
    """``(t, key, cell, d, fp, table)``: every group that a fingerprint belongs to."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_masks())])
    cells = F.array_distinct(F.array((F.col("d") / CELL).cast("int"), ((F.col("d") + RADIUS) / CELL).cast("int")))
    return (
        fps.select("fp")
        .mapInArrow(_with_coordinates, "fp long, d int, table binary")
        .select("fp", "d", "table", F.explode(tables).alias("g"), cells.alias("cells"))
        .select("fp", "d", "table", "g.t", "g.key", F.explode("cells").alias("cell"))
    )


def _join(label: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Labels after the parts of ``a`` and ``c`` are joined."""
    root = np.arange(len(label))
    np.minimum.at(root, np.maximum(label[a], label[c]), np.minimum(label[a], label[c]))
    while not np.array_equal(root[root], root):
        root = root[root]
    return root[label]


def _matches(group: np.ndarray, d: np.ndarray, table: np.ndarray, fp: np.ndarray, part: np.ndarray, radius: int, fresh: int, sets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different parts within the radius and, where their sets are given, similar.
    Rows are sorted by group and ``d``; pairs among the first ``fresh`` rows were seen before. A
    pair joins the parts of its rows, and of joined parts no more pairs are given."""
    n = len(group)
    _, first, of = np.unique(part, return_index=True, return_inverse=True)
    label, live, k, out = first[of], np.arange(n), 1, []
    while True:
        live = live[live + k < n]
        live = live[(group[live] == group[live + k]) & (d[live + k] - d[live] <= radius)]
        if not len(live):
            break
        a = live[(live + k >= fresh) & (label[live] != label[live + k])]
        c = a + k
        for j in range(1, table.shape[1]):
            if not len(a):
                break
            ok = np.abs(table[a, j].astype(np.int32) - table[c, j]) <= radius
            a, c = a[ok], c[ok]
        bits = np.bitwise_count(fp[a] ^ fp[c]).sum(axis=1, dtype=np.uint16)
        ok = bits <= radius
        if ok.any():
            a, c, bits = a[ok], c[ok], bits[ok]
            if sets is None:  # of pairs of the same two parts in this step the nearest is enough
                by = np.argsort(bits, kind="stable")
                _, one = np.unique((label[a] * n + label[c])[by], return_index=True)
                a, c = a[by][one], c[by][one]
            else:
                ok = np.array([alike(sets[x], sets[y]) for x, y in zip(a.tolist(), c.tolist())])
                a, c = a[ok], c[ok]
            out.append((a, c))
            label = _join(label, a, c)
        if k & (k - 1) == 0:  # now and then, groups whose rows are all joined are left
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.append(first, n))
            joined = np.minimum.reduceat(label, first) == np.maximum.reduceat(label, first)
            live = live[~np.repeat(joined, size)[live]]
        k += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(n_keys: int, words: int, radius: int, pair_type, exact: bool = False):
    """Links inside groups, from rows ``(keys..., d, table, fp, id, part)`` sorted by keys and ``d``;
    ``exact`` ones from rows that hold their shingle sets as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.begin("simhash")
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_keys)], axis=1)
            d = b.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int32)
            table = b.column(n_keys + 1)
            table = _rows_of(table, pair_type, len(table[0].as_py()) // np.dtype(pair_type).itemsize)
            fp = _rows_of(b.column(n_keys + 2), np.uint64, words) if words > 1 else b.column(n_keys + 2).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
            rows = [keys, d, table, fp, *(b.column(n_keys + k).to_numpy(zero_copy_only=False) for k in (3, 4))]
            if exact:
                sets = np.empty(b.num_rows, dtype=object)
                sets[:] = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(n_keys + 5)]
                rows.append(sets)
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                rows = [np.concatenate(x) for x in zip(held, rows)]
            keys, d, table, fp, id_, part = rows[:6]
            new = np.ones(len(d), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            group = np.cumsum(new)
            a, c = _matches(group, d, table, fp, part, radius, fresh, rows[6] if exact else None)
            keep = (group == group[-1]) & (d >= d[-1] - radius)
            held = [x[keep] for x in rows]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(id_[a]), pa.array(id_[c])], ["u", "v"])

    return run


def links(fps: DataFrame) -> DataFrame:
    """``(u, v)`` links that connect all distinct fingerprints within the radius."""
    groups = _grouped(fps).select("t", "key", "cell", "d", "table", "fp", F.col("fp").alias("id"), F.col("fp").alias("part"))
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(n, "t", "key", "cell").sortWithinPartitions("t", "key", "cell", "d", "fp")
    return dealt.mapInArrow(_search(3, 1, RADIUS, np.uint8), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` per row; component_id is the smallest reachable id.

    Empty and null texts have fingerprint zero and are linked like any other; rows that
    repeat an id or a text are all returned. An empty table gives an empty result.
    """
    fps = cut(with_fingerprints(docs, id_col, text))
    own = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(links(own.select("fp")))
    joined = own.join(comp.select(F.col("v").alias("fp"), "component"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    low = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(low, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: Of the search by shingles: words of a shingle, least similarity, words of 64 bits in a
#: fingerprint, bands and minimum hashes in each.
SHINGLE, SIMILARITY, WIDTH = 5, 0.8, 16
BANDS, EACH = 12, 4
#: Bytes of text taken at a time; their hashes take some fifty times as much memory.
STEP_BYTES = 1 << 19
#: Bands of the rounds in which parts are joined by one pair: most copies share one of the first,
#: so that later bands find them joined.
ROUNDS = ((0, 1), (2, 3, 4), (5, 6, 7, 8, 9, 10, 11))
#: Rows of a partition of links, which bounds a task's memory; ends of ids that are told apart where
#: texts are looked up (a power of two).
ROWS_EACH, ENDS = 1 << 18, 1 << 20


def wide_radius(similarity: float = SIMILARITY) -> int:
    """Differing bits of wide fingerprints that a pair of the least similarity stays within, but for a
    chance of 0.001: three standard deviations above the mean."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * WIDTH
    return int(np.ceil(bits * share + 3 * np.sqrt(bits * share * (1 - share))))


def wide_pivots(n: int = N_PIVOTS) -> np.ndarray:
    return tx.mix(np.arange(1, n * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, WIDTH)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts, sorted in each, and where each text's begin (and the end)."""
    h, doc = tx.shingle_hashes([t.lower() for t in texts], SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprints (text, word) and bands (text, band); both zero for texts without words."""
    h, at = shingle_sets(texts)
    fps = np.zeros((len(texts), WIDTH), dtype=np.uint64)
    bands = np.zeros((len(texts), BANDS), dtype=np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return fps, bands
    first, size = at[some], np.diff(at)[some]
    for k in range(WIDTH):
        x = tx.mix(h + np.uint64(k * 0x632BE59BD9B4E019 + 1 & (1 << 64) - 1))
        for i, a, n in zip(some.tolist(), first.tolist(), size.tolist()):
            votes = np.zeros(64, dtype=np.int64)
            for b in range(a, a + n, 1 << 16):
                part = x[b : min(b + (1 << 16), a + n)]
                votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            fps[i, k] = np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]
    for k in range(BANDS):
        band = np.zeros(len(some), dtype=np.uint64)
        for j in range(EACH):
            least = np.minimum.reduceat(tx.mix(h ^ np.uint64((k * EACH + j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)), first)
            band = tx.mix(band * np.uint64(0x9E3779B97F4A7C15) + least)
        bands[some, k] = band
    return fps, bands


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tx.begin("simhash")
    piv = wide_pivots()
    for b in batches:
        rows = ((i, t.as_py()) for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        for part in tx.pieces(rows, lambda x: len(x[1]) + 100, STEP_BYTES):
            fps, bands = sketch([t for _, t in part])
            table = _coordinates(fps, piv).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in part], pa.int64()), pa.array(table[:, 0].astype(np.int32)), _bytes_of(table), _bytes_of(fps)]
                + [pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * BANDS, pa.array(bands.view(np.int64).ravel()))],
                ["id", "d", "table", "fp", "bands"],
            )


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links whose texts are similar enough, from ``(u, v, text of u, text of v)``."""
    tx.begin("simhash")
    for b in batches:
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3))
        rows = ((u, v, x.as_py(), y.as_py()) for u, v, x, y in rows)
        for part in tx.pieces(rows, lambda x: len(x[2]) + len(x[3]) + 100, STEP_BYTES):
            h, at = shingle_sets([x[k] for x in part for k in (2, 3)])
            sets = [h[a:b] for a, b in zip(at, at[1:])]
            keep = [(u, v) for i, (u, v, _, _) in enumerate(part) if alike(sets[2 * i], sets[2 * i + 1])]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*keep)], ["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tx.begin("simhash")
    for b in batches:
        for part in tx.pieces(((i, t.as_py()) for i, t in zip(b.column(0).to_pylist(), b.column(1))), lambda x: len(x[1]) + 100, STEP_BYTES):
            h, at = shingle_sets([t for _, t in part])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["id", "shingles"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a partition's links, and the smallest that it reaches by them."""
    node, least = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        ends = [np.concatenate((x, b.column(k).to_numpy(zero_copy_only=False))) for k, x in enumerate((node, least))]
        names, at = np.unique(np.concatenate(ends), return_inverse=True)
        u, v = np.split(at, 2)
        label = np.arange(len(names))
        while len(u):
            label = _join(label, u, v)
            apart = label[u] != label[v]
            u, v = u[apart], v[apart]
        node, least = names, names[label]
    if len(node):
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["v", "component"])


def _few(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, written, in partitions of about ``ROWS_EACH`` rows, and its rows: what reads a small
    result then leaves few files."""
    df = cut(df)
    n = df.count()
    return df.coalesce(max(1, -(-n // ROWS_EACH))), n


def parts_of(links: DataFrame) -> DataFrame:
    """``(v, component)``, written, for every node of ``links(u, v)``; component is the smallest node.
    Links are contracted where they lie, so rounds between partitions are left to many links."""
    links, n = _few(links)
    stars = links.mapInArrow(_stars, "v long, component long")
    if n <= ROWS_EACH:
        return _few(stars)[0]
    return _few(connected_components(stars.select(F.col("v").alias("u"), F.col("component").alias("v"))))[0]


def texts_of(texts: DataFrame, need: DataFrame) -> DataFrame:
    """The text of each of ``need(id)``, once. Only texts whose id ends like a needed one are dealt
    out; of such ends there are few enough to be sent to all tasks."""
    end = F.col("id").bitwiseAND(ENDS - 1).alias("end")
    near = texts.select("*", end).join(F.broadcast(need.select(end).distinct()), "end", "left_semi").drop("end")
    return near.join(need, "id", "left_semi").dropDuplicates(["id"])


def similar_texts(texts: DataFrame) -> DataFrame:
    """``(u, v)``: verified links that join similar texts of ``texts(id, text)``; UTF-8 bytes, under ids
    that name a text each and may repeat with it. Texts without words are alike.

    Only sketches move; of the texts themselves only those that have a link to verify do.
    """
    sketches = texts.mapInArrow(_sketches, "id long, d int, table binary, fp binary, bands array<long>")
    sketches = cut(sketches.dropDuplicates(["id"]))
    bands = sketches.select("id", F.posexplode("bands").alias("t", "key"))
    shared = bands.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    bands = cut(bands.join(shared, ["t", "key"]))
    sketches = sketches.drop("bands")
    named = sketches.withColumn("part", F.col("id"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    radius = wide_radius()
    cols = ["t", "key", "d", "table", "fp", "id", "part"]
    deal = lambda df: df.repartition(n, "t", "key").sortWithinPartitions("t", "key", "d", "id")
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    verified, failed, n_failed = None, None, 0
    for some_bands in ROUNDS:
        # a part of rows is joined by one pair, which is verified afterwards
        rows = bands.filter(F.col("t").isin(*some_bands)).join(named, "id").select(*cols)
        found = ordered(deal(rows).mapInArrow(_search(2, WIDTH, radius, np.uint16), "u long, v long"))
        found, _ = _few(found if failed is None else found.join(failed, ["u", "v"], "left_anti"))
        some = cut(texts_of(texts, found.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
        one, two = (some.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
        good, _ = _few(found.join(one, "u").join(two, "v").select("u", "v", "text_u", "text_v").mapInArrow(_verified, "u long, v long"))
        verified = good if verified is None else verified.unionByName(good)
        bad = found.join(good, ["u", "v"], "left_anti")
        failed, n_failed = _few(bad if failed is None else failed.unionByName(bad))
        part = parts_of(verified).select(F.col("v").alias("id"), F.col("component").alias("part"))
        named = sketches.join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    if not n_failed:
        return verified
    # what a pair that failed has hidden lies in the parts of its ends: their rows alone are dealt
    # out once more, with their shingles, and joined by similar pairs only; a group of one part has none
    ends = failed.select(F.explode(F.array("u", "v")).alias("id")).join(named, "id").select("part").distinct()
    own = cut(named.join(ends, "part"))
    near = bands.join(own.select("id", "part"), "id")
    mixed = near.groupBy("t", "key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("t", "key")
    near = cut(near.drop("part").join(mixed, ["t", "key"]))
    sets = cut(texts_of(texts, near.select("id").distinct()).mapInArrow(_sets, "id long, shingles binary"))
    rows = near.join(own, "id").join(sets, "id").select(*cols, "shingles")
    return verified.unionByName(ordered(deal(rows).mapInArrow(_search(2, WIDTH, radius, np.uint16, True), "u long, v long")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar texts stays: that of the smallest id. All columns are kept.

    Rows with a null id take no part in the search and stay. Of equal rows one stays; rows
    that share an id but not the text are documents of their own, and one whose text is like
    no other's stays. Null texts are empty. Columns may have any names.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), key.alias("key"))
    known = rows.filter("id is not null")
    body = F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary")
    comp = parts_of(similar_texts(known.select(F.col("key").alias("id"), body.alias("text"))))
    first = known.groupBy("key").agg(F.min("id").alias("id"))
    named = first.join(comp.select(F.col("v").alias("key"), "component"), "key", "left")
    named = named.select("key", "id", F.coalesce("component", "key").alias("component"))
    stay = named.groupBy("component").agg(F.min(F.struct("id", "key")).alias("s")).select("s.id", "s.key")
    # the whole row, however often it repeats, is at one place: (id, key)
    kept = known.join(stay, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return kept.unionByName(rows.filter("id is null")).select("row.*")
