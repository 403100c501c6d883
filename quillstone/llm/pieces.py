"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here and rebuilt as a tokenizer: its normaliser (character
map, removal of extra spaces, escape of spaces by the metaspace marker, dummy prefix), its
pieces with their unigram scores (unigram models) or their merges in the order of those
scores (BPE models), and its byte fallback. Batches are encoded by several threads.

A whole text is one sequence. It is cut before runs of markers only where no piece of the
model can span the cut, which lets the library reuse the pieces of words it has met.

Null texts count as empty: no pieces. Rows that repeat are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx

#: Where the model lies unless a caller names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
#: Words whose pieces a process keeps.
CACHED_WORDS = 300_000
# Fixed values of the model format: field numbers and kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            v = b[i : i + n]
            i += n
        yield tag >> 3, v


@dataclass
class Pieces:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False


def parse(raw: bytes) -> Pieces:
    m = Pieces()
    for number, v in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, x in fields(v):
                if k == 1:
                    piece = x.decode()
                elif k == 2:
                    score = struct.unpack("<f", x)[0]
                elif k == 3:
                    kind = x
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, x in fields(v):
                if k == 3:
                    m.kind = x
                elif k == 24:
                    m.suffix = bool(x)
                elif k == 35:
                    m.byte_fallback = bool(x)
                elif k == 40:
                    m.unk = x
        elif number == 3:
            for k, x in fields(v):
                if k == 2:
                    m.charsmap = x
                elif k == 3:
                    m.dummy_prefix = bool(x)
                elif k == 4:
                    m.remove_extra = bool(x)
                elif k == 5:
                    m.escape = bool(x)
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are known")
    if m.suffix or not m.escape:
        raise ValueError("markers after words and unescaped spaces aren't supported")
    return m


def _merges(m: Pieces) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score of the third first."""
    known = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
    out = []
    for p, score, k in m.pieces:
        if k != NORMAL or len(p) < 2:
            continue
        for i in range(1, len(p)):
            a, b = p[:i], p[i:]
            if a in known and b in known:
                out.append((-score, known[a], known[b], a, b))
    return [(a, b) for *_, a, b in sorted(out)]


def cut_pattern(m: Pieces) -> str | None:
    """A pattern of the stretches that no piece spans, or None where there are none."""
    plain = [p for p, _, k in m.pieces if k in (NORMAL, USER)]
    if m.kind != BPE or any(MARK in p.lstrip(MARK) for p in plain) or any(k == USER for *_, k in m.pieces):
        return None
    if any("\n" in p for p in plain):
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
    return f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"


def build(raw: bytes):
    """A ``tokenizers.Tokenizer`` with the behaviour of the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(raw)
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, _merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence(steps)
    if pattern := cut_pattern(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(pattern), "isolated")
    users = [AddedToken(p, normalized=True, special=False) for p, _, k in m.pieces if k == USER]
    if users:
        t.add_tokens(users)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(back)
    return t


class Runs:
    """Runs of markers. Where all their pieces score alike, the model joins leftmost pairs
    first, which an order of merges can't say; their pieces are worked out here instead."""

    def __init__(self, m: Pieces) -> None:
        own = [(i, len(p), s) for i, (p, s, k) in enumerate(m.pieces) if k == NORMAL and p and not p.strip(MARK)]
        self.length = np.zeros(len(m.pieces), dtype=np.int64)
        for i, n, _ in own:
            self.length[i] = n
        self.of = {n: (i, s) for i, n, s in own}
        self.tied = m.kind == BPE and len({s for _, _, s in own}) < len(own)
        self.known: dict[int, list[int]] = {}

    def pieces(self, k: int) -> list[int]:
        """Ids for ``k`` markers: the best score first, then the leftmost pair."""
        if k in self.known:
            return self.known[k]
        size, after, before = [1] * k, list(range(1, k + 1)), list(range(-1, k - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < k and size[i] + size[after[i]] in self.of:
                n = size[i] + size[after[i]]
                heapq.heappush(heap, (-self.of[n][1], i, size[i], n))

        for i in range(k):
            offer(i)
        while heap:
            _, i, left, n = heapq.heappop(heap)
            if size[i] != left or after[i] >= k or left + size[after[i]] != n:
                continue
            j = after[i]
            size[i], size[j], after[i] = n, 0, after[j]
            if after[i] < k:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out = [self.of[n][0] for n in size if n]
        if len(self.known) < 4096:
            self.known[k] = out
        return out

    def fix(self, ids: list[int]) -> list[int]:
        n = self.length[ids]
        if not (n[1:].astype(bool) & n[:-1].astype(bool)).any() and not (n > 1).any():
            return ids
        out, run = [], 0
        for i, k in zip(ids, n.tolist()):
            if k:
                run += k
                continue
            if run:
                out += self.pieces(run)
                run = 0
            out.append(i)
        return out + (self.pieces(run) if run else [])


class Coder:
    """Encodes and decodes batches with one model, keeping the pieces of words it has met."""

    def __init__(self, raw: bytes) -> None:
        self.model = parse(raw)
        self.whole, self.runs = build(raw), Runs(self.model)
        self.plain = not self.model.charsmap and not self.model.remove_extra
        # words can be encoded one by one where no piece spans the cut between them
        self.cut = None
        if self.whole.pre_tokenizer is not None:
            self.cut = re.compile(cut_pattern(self.model))
            self.words = build(raw)
            self.words.normalizer = None
            feed = self.words.encode("\n", add_special_tokens=False).ids
            self.feed = feed[0] if len(feed) == 1 and "\n" in self.cut.pattern else None
        self.known: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        if self.cut is not None and self.feed is not None:
            self.known["\n"] = np.int32(self.feed).tobytes()

    def normal(self, text: str) -> str:
        """What the normaliser makes of a text."""
        if not self.plain:
            return self.whole.normalizer.normalize_str(text)
        return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.cut is None:
            found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, dtype=np.int32) for e in found]
        split = [self.cut.findall(self.normal(t)) for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known))
        if len(known) + len(new) > CACHED_WORDS:
            self._forget()
            new = list(set().union(*split).difference(known))
        for w, ids in zip(new, self._each(new)):
            known[w] = ids
        if self.runs.tied:
            for w in new:
                if w.startswith(MARK * 2):
                    ids = np.frombuffer(known[w], dtype=np.int32).tolist()
                    known[w] = np.array(self.runs.fix(ids), dtype=np.int32).tobytes()
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), dtype=np.int32) for w in split]

    def _each(self, words: list[str]) -> Iterator[bytes]:
        """Pieces of each word, as 32-bit numbers. Where a line feed always is a piece of its own, words are sent
        to the library as lines of a few texts and told apart again by that piece."""
        if self.feed is None or "\n" in words:
            for e in self.words.encode_batch_fast(words, add_special_tokens=False):
                yield np.array(e.ids, dtype=np.int32).tobytes()
            return
        at = range(0, len(words), 2000)
        for k, e in zip(at, self.words.encode_batch_fast(["\n".join(words[i : i + 2000]) for i in at], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.int32)
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids)).tolist()
            ids, start = ids.tobytes(), 0
            if len(ends) != len(words[k : k + 2000]):
                raise RuntimeError("words and pieces differ")
            for end in ends:
                yield ids[4 * start : 4 * end]
                start = end + 1

    def decode(self, ids: list) -> list[str]:
        return self.whole.decode_batch([x.tolist() if isinstance(x, np.ndarray) else x for x in ids], skip_special_tokens=False)


_CODERS: dict[str, Coder] = {}
tx.KEPT["pieces"] = _CODERS


def coder(raw: bytes) -> Coder:
    """The coder of a model, built once a process."""
    tx.begin("pieces")
    key = hashlib.sha256(raw).hexdigest()
    if key not in _CODERS:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        _CODERS[key] = Coder(raw)
    return _CODERS[key]


ENCODED = "doc_id long, ids array<int>, n_pieces long, round_trip boolean"


def read_model(df: DataFrame, path: str = MODEL) -> bytes:
    """The model's bytes, read once by the driver (about a megabyte) and sent to the tasks."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(df.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, n_pieces, round_trip)`` of every row.

    ``round_trip`` says whether decoding gives the text back; it doesn't where a text holds
    the marker itself, which decodes as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1))
            for part in tx.pieces(((i, t.as_py() or "") for i, t in rows), lambda x: len(x[1]) + 200, 2 << 20):
                texts = [t for _, t in part]
                ids = c.encode(texts)
                back = c.decode(ids)
                n = np.array([len(x) for x in ids], dtype=np.int64)
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in part], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(n), pa.array([x == y for x, y in zip(texts, back)])],
                    ["doc_id", "ids", "n_pieces", "round_trip"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of every row; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            back = c.decode([x or [] for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "doc_id long, text string")
