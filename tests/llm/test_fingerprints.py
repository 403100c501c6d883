import hashlib

import numpy as np

from quillstone.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string"


def jaccard(a, b):
    def s(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_against_exact_jaccard(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join("w%d" % x for x in rng.integers(0, 5000, n)) for n in (3, 30, 80, 300, 1000, 3000, 2000, 7)]
    texts += ["", None, "é ü ß 日本 " * 40, texts[4], "", " \n"]
    df = spark.createDataFrame([(i * 3, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in fp.compare_with_next(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        r = got[i * 3]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(t, e)) < 0.13, i
        assert abs(r.near_next - jaccard(t, nxt)) < 0.13, i
    assert got[12].fingerprint == got[33].fingerprint
    assert got[24].fingerprint == got[27].fingerprint == "0" * 512


def test_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    err = []
    for _ in range(60):
        a = [str(x) for x in rng.integers(0, 10**6, 400)]
        b = a[:250] + [str(x) for x in rng.integers(0, 10**6, 150)]
        x, s = fp._bins([" ".join(a).encode(), " ".join(b).encode()])
        err.append(fp.likeness(x[:1], x[1:], s[:1], s[1:])[0] - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(err)) < 0.012 and np.std(err) < 0.04


def test_one_row_none_and_repeated_ids(spark):
    one = fp.compare_with_next(spark.createDataFrame([(5, "a b c d e f g", "x")], SCHEMA)).collect()
    assert one[0].near_next == 1.0
    assert fp.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "b", "x"), (1, "b", "x"), (None, "n", "x"), (2, "c", "x")]
    assert fp.compare_with_next(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_table_matches_comparison(spark):
    df = spark.createDataFrame([(i, f"text number {i} has some words in it", "x") for i in range(30)], SCHEMA)
    a = {r.doc_id: r.fingerprint.hex() for r in fp.fingerprint_table(df).collect()}
    assert a == {r.doc_id: r.fingerprint for r in fp.compare_with_next(df).collect()}


M64 = (1 << 64) - 1


def slow_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def slow_fingerprint(text):
    """One bin at a time, in whole numbers; a word's hash is the sum of its bytes' codes times powers."""
    mult = 0x9E3779B97F4A7C15
    odd = mult | 1
    word = lambda w: slow_mix(sum(slow_mix((v + 1) * mult & M64) * pow(odd, i, 1 << 64) for i, v in enumerate(w)) & M64)
    w = [word(x) for x in text.split()]
    if not w:
        return "0" * (fp.BINS * fp.BITS // 4)
    low = [None] * fp.BINS
    for at in range(max(1, len(w) - 4)):
        h = 0
        for k in range(5):
            step = w[at + k] if at + k < len(w) else 0x5851F42D4C957F2D
            h = slow_mix((h * mult + step) & M64)
        b, rest = h >> 55, h & (1 << 55) - 1
        low[b] = rest if low[b] is None else min(low[b], rest)
    out = []
    for b in range(fp.BINS):
        at, attempt = b, 0
        while low[at] is None:  # optimal densification
            attempt += 1
            at = slow_mix(b + fp.BINS * attempt) % fp.BINS
        out.append(slow_mix(low[at]) & 15)
    return bytes(a | b << 4 for a, b in zip(out[::2], out[1::2])).hex()


def test_fingerprint_against_plain_loops():
    rng = np.random.default_rng(6)
    texts = [" ".join("w%d" % x for x in rng.integers(0, 900, n)).encode() for n in (1, 4, 5, 6, 40, 700)] + [b"", " é 日本 x".encode()]
    bins, _ = fp._bins(texts)
    assert [x.hex() for x in fp.packed(bins)] == [slow_fingerprint(t) for t in texts]


def test_long_texts_and_many_rows_of_one_id(spark):
    rows = [(7, "x%d " % i * 3, "c") for i in range(300)] + [(8, "long words " * 60_000, "c"), (6, None, "c")]
    got = fp.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 7 for r in got) == 300
    assert next(r.n_chars for r in got if r.doc_id == 8) == 660_000
    assert sorted(fp.homes_of(spark, 9)) == sorted(set(fp.homes_of(spark, 9)))
