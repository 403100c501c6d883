"""Personal data: patterns, and a character-level BiLSTM-CRF that adds to them.

The patterns give the base spans. The tagger (see ``tagger``) is trained in numpy from
labelled spans: the base spans of a bounded sample of texts, and such data in forms that
the patterns don't know, written into plain stretches of the sample. Every whole text is
cut into overlapping windows, each is decoded, and the windows of a text are reconciled:
each character takes its label from the window in which it stands farthest from an edge,
and a span is a longest run of one label. A span that the tagger adds must touch no base
span and read as its kind (enough digits, a plausible address); base spans always stay.

Offsets are in code points, ends exclusive. Null texts are empty. Rows that repeat get the
same spans. Nothing in a text is skipped: texts of any length are tagged whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import tagger as tg
from quillstone.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
#: Texts of the training sample, in the mean, and windows made of each.
TRAIN_TEXTS = 800
TRAIN_WINDOW = 64
TRAIN_CHARS = 4_000
#: Windows of decoding: their length, how much two neighbours share, how many at once.
WINDOW, SHARED, LANES = 512, 64, 2048

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(s: str) -> bool:
    d = _DIGITS.sub("", s)
    return 16 <= len(d) <= 19 and luhn(d)


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _phone(s: str) -> bool:
    return 8 <= len(_DIGITS.sub("", s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base spans, by kind, then start."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:  # the part before an @ reaches back as far as it can, never over the last match
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for kind, pattern, ok in ((1, _IP, _ip), (2, _CARD, _card), (3, _PHONE, _phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if ok(m.group())]
    return out


def plausible(kind: int, s: str) -> bool:
    """Whether a span that only the tagger found reads as its kind."""
    d = _DIGITS.sub("", s)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|\(at\)|\[at\]| at )\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[\w-]+)+", s))
    if kind == 1:
        parts = re.split(r"\s?(?:\.|\[\.\]|\(\.\))\s?", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[:4]) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 .\-]", s)
    return 7 <= len(d) <= 15 and bool(re.fullmatch(r"\+?[0-9().\-/ ]*[0-9]", s)) and bool(re.search(r"[()\-./ ]", s)) and not re.search(r"[0-9]{9}", s)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card_number(rng) -> str:
    d = "4" + _digits(rng, 14)
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def _sample_span(rng, word: str) -> tuple[int, str]:
    """A made-up piece of personal data, in forms both known and unknown to the patterns."""
    kind = int(rng.integers(0, 4))
    w = re.sub(r"[^a-z]", "", word.lower()) or "name"
    if kind == 0:
        host = [f"mail{rng.integers(0, 10)}.example.com", f"{w}.org", "example.net", f"{w[::-1]}.co.uk"][rng.integers(0, 4)]
        name = [f"{w}.{rng.integers(0, 100):02d}", w, f"{w}_{w[::-1]}", f"{w}{rng.integers(0, 99)}"][rng.integers(0, 4)]
        form = rng.integers(0, 8)
        if form == 0:
            return 0, f"{name} (at) {host.replace('.', ' (dot) ')}"
        if form == 1:
            return 0, f"{name} [at] {host}"
        return 0, f"{name}@{host}"
    if kind == 1:
        return 1, ("[.]" if rng.integers(0, 8) == 0 else ".").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        c = _card_number(rng)
        sep = ["", " ", "-", ".", ""][rng.integers(0, 5)]
        return 2, sep.join(c[i : i + 4] for i in range(0, 16, 4)) if sep else c
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return 3, [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}"][rng.integers(0, 6)]


def _sample_other(rng) -> str:
    """Numbers and marks that are no personal data."""
    return [
        f"version {rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", str(rng.integers(1900, 2100)), f"${rng.integers(1, 10**6):,}", _digits(rng, int(rng.integers(1, 7))),
        f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}", f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", "".join(rng.choice(list("0123456789abcdef"), 32)), f"#{rng.integers(0, 10**5)}", f"@{''.join(rng.choice(list('abcdefgh'), 6))}", _digits(rng, 20),
    ][rng.integers(0, 10)]


def training_windows(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and labels from sampled texts (windows, TRAIN_WINDOW)."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(t: str, spans) -> None:
        x, y = tg.classes(t), np.zeros(len(t), dtype=np.uint8)
        for k, s, e in spans:
            y[s:e] = k + 1
        xs.append(np.pad(x[:TRAIN_WINDOW], (0, max(0, TRAIN_WINDOW - len(x)))))
        ys.append(np.pad(y[:TRAIN_WINDOW], (0, max(0, TRAIN_WINDOW - len(y)))))

    for t in texts or ["plain words and nothing else " * 4]:
        found = base_spans(t)
        for k, s, e in found[:4]:
            a = max(0, s - int(rng.integers(0, 30)))
            inside = [(q, u - a, v - a) for q, u, v in found if u >= a]
            add(t[a : a + TRAIN_WINDOW], inside)
        for form in range(4):
            a = int(rng.integers(0, max(1, len(t) - 40)))
            plain = t[a : a + int(rng.integers(2, 40))].rstrip() + " "
            if base_spans(plain):
                continue
            tail = " " + t[a + 40 : a + 40 + TRAIN_WINDOW]
            if form == 0:
                add(plain + tail, [(k, s, e) for k, s, e in base_spans(plain + tail)])
                continue
            if form == 1:
                put, label = _sample_other(rng), []
            else:
                k, put = _sample_span(rng, re.split(r"\s", plain.strip())[-1])
                label = [(k, len(plain), len(plain) + len(put))]
                if form == 3 and rng.integers(0, 2):  # data side by side
                    k, more = _sample_span(rng, put)
                    label.append((k, len(plain) + len(put) + 1, len(plain) + len(put) + 1 + len(more)))
                    put += " " + more
            whole = plain + put + tail
            label += [x for x in base_spans(whole) if x[1] > len(plain) + len(put)]
            add(whole, label)
    return np.array(xs), np.array(ys)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tg.Tagger:
    """Train on a sample of ``TRAIN_TEXTS`` texts in the mean, drawn by a hash of the row.

    Of a sampled text ``TRAIN_CHARS`` characters in a row are learnt from, from a place that a
    hash tells, or all it has; so what the driver gets is bounded. Half the sample comes from texts that have digits or an @, where there are any.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.xxhash64(F.col(id_col), F.lit("pii")).alias("h")).filter("t <> ''")
    n = docs.count()

    def share(k: float):
        return F.pmod(F.shiftrightunsigned("h", 20), F.lit(1 << 30)) < int(min(1.0, k / max(n, 1)) * (1 << 30))

    marked = F.col("t").rlike("[0-9@]")
    begin = F.pmod(F.xxhash64("h", "t"), F.greatest(F.length("t") - TRAIN_CHARS, F.lit(0)) + 1).cast("int")
    stretch = F.substring(F.col("t"), begin + 1, F.lit(TRAIN_CHARS))
    drawn = rows.filter(share(8.0 * TRAIN_TEXTS)).select("h", stretch.alias("t"), marked.alias("m"), share(TRAIN_TEXTS / 2).alias("s"))
    drawn = drawn.filter("m or s").orderBy(F.col("s").desc(), "h", "t").limit(TRAIN_TEXTS).select("t")
    return tg.train(*training_windows([r.t for r in drawn.collect()]))


def emissions(model: tg.Tagger, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (place, K) of all characters of the texts, one after the other, and where each text
    begins (and the end). Where windows overlap their scores are averaged, each weighing less
    towards its end."""
    xs = [tg.classes(t) for t in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in xs], dtype=np.int64)))
    out = np.zeros((at[-1], tg.K), dtype=np.float32)
    where = [(i, s) for i, x in enumerate(xs) for s in range(0, max(1, len(x) - SHARED), WINDOW - SHARED) if len(x)]
    where.sort(key=lambda w: -min(WINDOW, len(xs[w[0]]) - w[1]))
    rise = ((np.arange(SHARED) + 1) / (SHARED + 1)).astype(np.float32)[:, None]
    for k in range(0, len(where), LANES):
        part = where[k : k + LANES]
        n = np.array([min(WINDOW, len(xs[i]) - s) for i, s in part])
        grid = np.zeros((len(part), int(n[0])), dtype=np.uint8)
        for j, (i, s) in enumerate(part):
            grid[j, : n[j]] = xs[i][s : s + n[j]]
        e = model.emissions(np.ascontiguousarray(grid.T), n)
        for j, (i, s) in enumerate(part):
            own = e[: n[j], :, j]
            if s:
                own[:SHARED] *= rise[: n[j]]
            if s + n[j] < len(xs[i]):
                own[-SHARED:] *= rise[::-1]
            out[at[i] + s : at[i] + s + n[j]] += own
    return out, at


def tag(model: tg.Tagger, texts: list[str]) -> list[np.ndarray]:
    """Label of every character of every text: windows overlap, and one path over all of a text
    decides (see ``Tagger.best_of_texts``)."""
    e, at = emissions(model, texts)
    label = model.best_of_texts(e, at)
    return [label[a:b] for a, b in zip(at, at[1:])]


def _runs(label: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], label, [0]))))
    return [(int(label[a]) - 1, int(a), int(b)) for a, b in zip(edge, edge[1:]) if label[a]]


def add_spans(text: str, base: list[tuple[int, int, int]], label: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans and those of the tagger that touch none and read as their kind."""
    if not label.any():
        return base
    taken = np.zeros(len(text) + 1, dtype=bool)
    for _, s, e in base:
        taken[s:e] = True
    out = list(base)
    for k, s, e in _runs(label):
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1] in " \t\n\r.,;:":
            e -= 1
        if e > s and not taken[s:e].any() and not text[max(0, s - 1)].isalnum() * (s > 0) and not text[e : e + 1].isalnum() and plausible(k, text[s:e]):
            out.append((k, s, e))
    return sorted(out)


def find_spans(model: tg.Tagger, texts: list[str]) -> tuple[list, list]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    return base, [add_spans(t, b, y) for t, b, y in zip(texts, base, tag(model, texts))]


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, model: tg.Tagger, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: counts of base spans by kind, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.begin("pii")
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1))
            for part in tx.pieces(((i, t.as_py() or "") for i, t in rows), lambda x: len(x[1]) + 400, 1 << 20):
                base, every = find_spans(model, [t for _, t in part])
                counts = [[sum(k == kind for k, *_ in x) for x in base] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in part], pa.int64()),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array([hashlib.sha256(spans_text(x).encode()).hexdigest() for x in base]),
                        pa.array([spans_text(x) for x in every]),
                    ],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, RESULT)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch of spans replaced by a mark of its first span's kind."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s < at:
            if e > at:  # overlapping spans are one stretch
                at = e
            continue
        out += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: tg.Tagger, text: str = "text") -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced; other columns pass through as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.begin("pii")
        for b in batches:
            texts, done = b.column(at), 0
            for part in tx.pieces((t.as_py() for t in texts), lambda x: len(x or "") + 400, 1 << 20):
                _, spans = find_spans(model, [t or "" for t in part])
                new = [None if t is None else redact_text(t, s) if s else t for t, s in zip(part, spans)]
                cols = [pa.array(new, texts.type) if i == at else c for i, c in enumerate(b.slice(done, len(part)).columns)]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
                done += len(part)

    return docs.mapInArrow(run, docs.schema)
