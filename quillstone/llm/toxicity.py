"""Toxicity from two class-conditional Kneser-Ney models.

A word's count in a class is its Kneser-Ney continuation count: the number of distinct words
that it follows in texts of the class. Every level of a class's model interpolates counts,
less ``DISCOUNT``, with a shorter one: a word with its first six bytes, those with the first
four, and these with the counts of both classes together. How a prefix's share is parted among
its words is told by the counts of both classes as well, so it is the same in both models: an
expression too rare to tell the classes apart has the ratio of its stem, and a rare stem hardly
any. What the two log-likelihoods of a text differ by, length-normalised, becomes a probability
by a logistic curve, fitted on labelled rows outside the counts. The curve sees the difference
a word, and the part of it that lies in single telling words (above ``TELLING``) over the root
of the number of words, since a long text with ten insults is toxic though the mean is small.

The order above, words conditioned on the word before, was measured and left out: on the
driver's tables a class's share of left-over mass differs by context with the size of the class
alone, which cost a quarter of the recall (README).

The models are fitted on a bounded sample of labelled rows (``MAX_LABELLED`` in the mean,
drawn by a hash of the id). Of its words all that have counts above the discount in either
class are collected; by the formula all others are determined by their prefixes, so none is
dropped. Every text is scored whole.

Words are lower-cased and parted by all ASCII characters but letters and digits. Null and
empty texts score what a text that says nothing scores. Labels that are null are ignored;
an id labelled more than once counts as its highest label;
of exact copies with one label a single one is learnt from. Without a row of each class to
learn from every score is 0. Rows that repeat are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.runtime import cut

#: Labelled rows to learn from, in the mean.
MAX_LABELLED = 16_000
#: Bytes of a word's prefixes, from short to long.
PREFIXES = (4, 6)
#: What counts lose to the shorter level; above 1, so that words met once or twice tell nothing.
DISCOUNT = 2
#: Log ratio above which a single word is telling.
TELLING = 2.0
_PART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def crc_remainder(id_col, modulus: int):
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words' prefixes and of the words (levels by words), and words of each text."""
    buf, at = tx.joined([t.lower().encode().translate(_PART) for t in texts])
    starts, ends = tx.words(buf)
    sums, down = tx.prefix_hash(buf), tx.POWERS.get(len(buf) + 1)[1][starts]
    keys = [tx.mix((sums[np.minimum(starts + k, ends)] - sums[starts]) * down) for k in PREFIXES]
    keys.append(tx.mix((sums[ends] - sums[starts]) * down))
    return np.stack(keys), np.diff(np.searchsorted(starts, at))


@dataclass
class Level:
    """Log ratios of a level's keys that have counts of their own, and what others add to those of
    the level above."""

    keys: np.ndarray  # sorted
    ratio: np.ndarray
    rest: float

    def __call__(self, h: np.ndarray, above: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return above + self.rest
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ratio[at], above + self.rest)


@dataclass
class Model:
    levels: list[Level] = field(default_factory=list)  # from the shortest prefix to the word
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log of a word's toxic probability over its ordinary one, and words of each text."""
        keys, n = _tokens(texts)
        out = np.zeros(keys.shape[1])
        for level, h in zip(self.levels, keys):
            out = level(h, out)
        return out, n

    def measure(self, texts: list[str]) -> np.ndarray:
        """Per text: the difference of log-likelihoods a word, and what telling words bring, over
        the root of the number of words."""
        out = np.zeros((len(texts), 2))
        ratio, n = self.ratios(texts)
        text_of = np.repeat(np.arange(len(texts)), n)
        out[:, 0] = np.bincount(text_of, ratio, len(texts)) / np.maximum(n, 1)
        out[:, 1] = np.bincount(text_of, np.maximum(ratio - TELLING, 0), len(texts)) / np.sqrt(np.maximum(n, 1))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.levels:
            return np.zeros(len(texts))
        x = self.measure(texts)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, label: str, modulus: int) -> DataFrame:
    """``(text, toxic, fold)`` of the bounded sample; fold 0 fits the curve, the others the counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("k")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    known = known.filter(crc_remainder(F.col("k"), modulus) != 0)
    n = known.count()
    share = int(min(1.0, MAX_LABELLED / max(n, 1)) * (1 << 31))
    drawn = known.filter(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 31)) < share)
    drawn = drawn.withColumn("fold", F.pmod(F.xxhash64("k", F.lit("fold")), F.lit(4)))
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(drawn), "k").select("text", "toxic", "fold", F.xxhash64("text").alias("copy"))
    return cut(found.dropDuplicates(["copy", "toxic"]).select("text", "toxic", "fold"))


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct bigrams of a batch: word before (0 at a text's start), keys of the word, classes."""
    for b in batches:
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        for part in tx.pieces(rows, lambda x: len(x[0]) + 100):
            keys, n = _tokens([t for t, _ in part])
            if not keys.shape[1]:
                continue
            w, before = keys[-1], np.zeros(keys.shape[1], dtype=np.uint64)
            before[1:] = w[:-1]
            before[(np.cumsum(n) - n)[n > 0]] = 0
            toxic = np.repeat(np.array([y for _, y in part], dtype=np.uint64), n)
            _, one = np.unique(tx.mix(tx.mix(before * np.uint64(0x9E3779B97F4A7C15) + w) + toxic), return_index=True)
            cols = [before, *keys[::-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[one].view(np.int64)) for x in cols] + [pa.array(((toxic[one] == y) * 1).astype(np.int32)) for y in (0, 1)],
                ["before", "word", *[f"p{k}" for k in PREFIXES[::-1]], "ordinary", "toxic"],
            )


BIGRAMS = "before long, word long, " + "".join(f"p{k} long, " for k in PREFIXES[::-1]) + "ordinary int, toxic int"


def _level(counts: DataFrame, key: str, above: str | None, totals: np.ndarray, parent) -> tuple[Level, dict]:
    """A level from ``(key, above, ordinary, toxic, both)``; ``parent`` maps the keys above to their
    probabilities by class and their counts of both classes."""
    left = [F.least(F.col(c), F.lit(DISCOUNT)) for c in ("ordinary", "toxic")]
    mass = np.array(counts.agg(*[F.sum(x) for x in left]).first(), dtype=np.float64)
    # others have no counts above the discount: their ratio is that of the level above
    some = counts.filter(F.greatest("ordinary", "toxic") > DISCOUNT).toPandas()
    n = some[["ordinary", "toxic"]].to_numpy(np.float64)
    both = some["both"].to_numpy(np.float64)
    p = np.ones_like(n)
    share = np.full(len(some), parent[None][1]) if above is None else np.ones(len(some))
    if above is not None:
        found = [parent[k] for k in some[above].tolist()]
        p = np.array([x[0] for x in found], dtype=np.float64).reshape(-1, 2)
        share = np.array([x[1] for x in found], dtype=np.float64)
    # a prefix's share is parted by the counts of both classes, one of them for what was never seen
    p = (np.maximum(n - DISCOUNT, 0) + mass * p * (both / (share + 1))[:, None]) / totals
    h = some[key].to_numpy(np.int64)
    order = np.argsort(h.view(np.uint64))
    level = Level(h.view(np.uint64)[order], np.log(p[order, 1] / p[order, 0]), float(np.log(mass[1] / totals[1]) - np.log(mass[0] / totals[0])))
    return level, {k: (tuple(x), y) for k, x, y in zip(h.tolist(), p.tolist(), both.tolist())}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", modulus: int = 5) -> Model:
    """Learn from labelled rows whose crc32(id as text) mod ``modulus`` is not 0."""
    sample = _sample(docs.select(id_col, "text"), labels.select(id_col, label), id_col, label, modulus)
    train = sample.filter("fold > 0").select("text", "toxic")
    pairs = train.mapInArrow(_bigrams, BIGRAMS).groupBy("before", "word")
    names = [f"p{k}" for k in PREFIXES[::-1]]
    once = pairs.agg(*[F.max(c).alias(c) for c in (*names, "ordinary", "toxic")])
    sums = [F.sum(c).alias(c) for c in ("ordinary", "toxic")]
    words = cut(once.groupBy("word").agg(*[F.max(c).alias(c) for c in names], *sums, F.count("*").alias("both")))
    total = words.agg(*sums, F.sum("both").alias("both")).first()
    if not total.ordinary or not total.toxic:
        return Model()
    totals = np.array([total.ordinary, total.toxic], dtype=np.float64)
    model, parent = Model(), {None: ((1.0, 1.0), float(total.both))}
    chain = ["word", *names]  # from the word to the shortest prefix
    for i in range(len(chain) - 1, -1, -1):
        key, above = chain[i], chain[i + 1] if i + 1 < len(chain) else None
        counts = words
        if i:
            longer = [F.max(above).alias(above)] if above else []
            counts = words.groupBy(key).agg(*longer, *sums, F.sum("both").alias("both"))
        level, parent = _level(counts, key, above, totals, parent)
        model.levels.append(level)
    model.curve = _curve(model, sample.filter("fold = 0").select("text", "toxic"))
    return model


def _curve(model: Model, rows: DataFrame) -> np.ndarray:
    """Logistic regression by Newton steps, on measures taken on the executors."""

    def run(batches):
        for b in batches:
            for part in tx.pieces(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), lambda x: len(x[0]) + 100):
                x = model.measure([t for t, _ in part])
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array([y for _, y in part], pa.int32())], ["a", "b", "y"])

    got = rows.mapInArrow(run, "a double, b double, y int").toPandas()
    y = got["y"].to_numpy(np.float64)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    curve = np.array([prior, 1.0, 1.0])
    x = np.column_stack([np.ones(len(y)), got[["a", "b"]].to_numpy(np.float64)])
    ridge = np.array([1e-3, 1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        grad = x.T @ (y - p) - ridge * curve
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        curve = curve + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return curve


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; nothing but the text enters the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1))
            for part in tx.pieces(((i, t.as_py() or "") for i, t in rows), lambda x: len(x[1]) + 100, 2 << 20):
                s = model.score([t for _, t in part])
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, score double")
