import math
import re
import zlib

import numpy as np
import pytest

from quillstone.llm import toxicity

DOCS = "doc_id long, text string, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    rng = np.random.default_rng(4)
    vocab = ["w%d" % i for i in range(800)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocab, int(rng.integers(30, 200))))
        bad = i % 6 == 0
        if bad:
            for k in range(0, len(w), 25):
                w[k] = rng.choice(["vileone", "viletwo", "vilethree", "rotten"]) + rng.choice(["", ",", "ish"])
        docs.append((i, " ".join(w).capitalize(), "clash"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(2000, None, "x"), (2001, "", "x"), (2002, "vilenever seen VILETWO form", "x"), (0, docs[0][1], "x"), (2003, "word " * 30000, "x")]
    d, lab = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(1, 0, None), (None, 1, 1), (3, 0, 0)], LABELS)
    model = toxicity.fit(d, lab)
    got = toxicity.score(d, model).collect()
    assert len(got) == len(docs) + len(extra)
    s = {r.doc_id: r.score for r in got}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    assert np.mean([(s[i] >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert s[2000] == s[2001] and s[2000] < 0.5 < s[2002] and 0 <= min(s.values()) <= max(s.values()) <= 1


def words_of(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())


def brute(rows):
    """A word's probabilities in both classes, from continuation counts in dictionaries."""
    pairs = [set(), set()]
    for text, y in rows:
        w = words_of(text)
        pairs[y] |= set(zip([None, *w], w))
    cuts = [*toxicity.PREFIXES, None]

    def counts(which):
        out = [{} for _ in cuts]
        for _, w in which:
            for c, k in zip(out, cuts):
                c[w[:k]] = c.get(w[:k], 0) + 1
        return out

    mine, both = [counts(x) for x in pairs], counts(pairs[0] | pairs[1])
    d, size = toxicity.DISCOUNT, [len(x) for x in pairs]

    def probability(w, y, level=len(cuts) - 1):
        """Of a word, or of its prefix; where it was never seen, of all unseen ones of its prefix."""
        p, share = (1.0, len(pairs[0] | pairs[1])) if level == 0 else (probability(w, y, level - 1), both[level - 1].get(w[: cuts[level - 1]], 0))
        key = w[: cuts[level]]
        mass = sum(min(c, d) for c in mine[y][level].values())
        return (max(mine[y][level].get(key, 0) - d, 0) + mass * p * (both[level].get(key, 0) or 1) / (share + 1)) / size[y]

    return probability, both


def test_against_dictionaries(spark):
    docs, labels = corpus(200)
    docs += [(5000 + i, f"vileone vilelike{i} rot rotte w1", "x") for i in range(20)]
    labels += [(5000 + i, 1, 1) for i in range(20)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(d, lab)
    sample = toxicity._sample(d.select("doc_id", "text"), lab.select("doc_id", "toxic"), "doc_id", "toxic", 5)
    probability, both = brute([(r.text, r.toxic) for r in sample.filter("fold > 0").collect()])
    seen = sorted(both[-1])
    # prefixes add up to one, with one share for all unseen ones
    for y in (0, 1):
        assert sum(probability(w, y, 0) for w in [*both[0], b"\xff\xff\xff\xff"]) == pytest.approx(1)
    words = [w.decode() for w in seen] + ["vilelikenever", "rottenmore", "zzzz", "w1x", "vi"]
    got, n = model.ratios(words)
    assert n.tolist() == [1] * len(words)
    assert got == pytest.approx([math.log(probability(w.encode(), 1) / probability(w.encode(), 0)) for w in words], rel=1e-9)
    texts = ["vileone w1 never", "", "w1 w2 w3 " * 50]
    for t, (a, b) in zip(texts, model.measure(texts)):
        r = [math.log(probability(w, 1) / probability(w, 0)) for w in words_of(t)] or [0.0]
        assert a == pytest.approx(sum(r) / len(r)) and b == pytest.approx(sum(max(x - toxicity.TELLING, 0) for x in r) / len(r) ** 0.5)


def test_labels_outside_the_share_do_not_matter(spark):
    docs, labels = corpus(300)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (toxicity.fit(d, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert all(np.array_equal(x.ratio, y.ratio) for x, y in zip(a.levels, b.levels)) and np.array_equal(a.curve, b.curve)


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b", "x")], DOCS)
    model = toxicity.fit(d, spark.createDataFrame([], LABELS))
    assert [r.score for r in toxicity.score(d, model).collect()] == [0.0]
    assert toxicity.score(d.limit(0), model).count() == 0
