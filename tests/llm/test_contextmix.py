import itertools
import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quillstone.llm import contextmix as cm

SCHEMA = "doc_id long, text string, key string"


def corpus(n=420):
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(300)] + ["É", "日本"]
    weight = 1 / np.arange(1, len(vocab) + 1)
    return [(i, " ".join(rng.choice(vocab, int(rng.integers(5, 90)), p=weight / weight.sum())).title(), "clash") for i in range(n)]


ODD = [(9000, None, "c"), (9001, "", "c"), (9002, " \n\t", "c"), (9003, "newword neverseen", "c"), (0, None, "c"), (9004, "the same " * 4000, "c"), (None, "a null id", "c")]


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def test_base_score_and_counts(spark):
    rows = corpus() + ODD
    rows[-3] = (0, rows[0][1], "c")  # a repeated row
    got = cm.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    train = Counter()
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    text = {i: t for i, t, _ in rows}
    for r in got:
        w = tokens(text[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0 and r.bits_per_byte > 0
    held = [r for r in got if r.held_out]
    assert np.mean([r.score > 1.15 * r.base_score for r in held]) > 0.9
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score == by[9002].score
    assert by[9004].bits_per_byte < 0.7  # repetition is learnt while reading


def test_score_is_the_same_however_words_are_counted(spark, monkeypatch):
    rows = corpus(120)
    rows += [rows[0], (70_000, "long" * 60 + " " + "word " * 3, "c"), (70_001, "long" * 60, "c")]
    df = spark.createDataFrame(rows, SCHEMA)

    def scored(many_parts=False):
        got = cm.score(df.repartition(7, "doc_id") if many_parts else df).collect()
        return sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in got)

    a = scored()
    monkeypatch.setattr(cm, "HOT_WORDS", 5)
    assert scored() == a
    monkeypatch.setattr(cm, "HOT_WORDS", 0)
    assert scored(True) == a


def model_of(texts):
    """A model made without Spark, and its raw counts."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    c = Counter()
    for b in cm._count_words(iter([batch])):
        c.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    words = pa.RecordBatch.from_arrays([pa.array(list(c.values()), pa.int64()), pa.array(list(c), pa.binary())], ["n", "word"])
    pairs = np.zeros(1 << 16, dtype=np.int64)
    for b in cm._count_pairs(iter([words])):
        pairs[b.column(0).to_numpy()] += b.column(1).to_numpy()
    code, sizes, counts, cells = cm.code_of(pairs.reshape(256, 256)), cm.table_bits(len(c)), [], []
    for part, run, batch in ((sizes[: cm.SPELLING], cm._count_spelling, words), (sizes[cm.SPELLING :], cm._count_contexts, batch)):
        (b,) = run(code, part)(iter([batch]))
        flat = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.uint32) for x in b.column(1)]).reshape(-1, 2)
        at = np.cumsum([1 << b for b in part])[:-1]
        odds, seen = cm._small(flat)
        counts += np.split(flat, at)
        cells += np.split(odds.view(np.uint8).astype(np.uint16) | seen.astype(np.uint16) << np.uint16(8), at)
    return cm.Model(code, cells, train_tokens=sum(c.values()), distinct=len(c)), counts


M32 = (1 << 32) - 1


def slow_bits(text, code, sizes):
    """``(token, is a byte's first, context slots, own slots, bit)`` of every bit, one at a time."""
    none = [int(x) for x in cm.tx.mix(np.arange(3, dtype=np.uint64))]
    words = text.lower().split() + [b""]
    names = [int(cm.word_hashes([w])[0]) for w in words]

    def top(x):
        return int(cm.tx.mix(np.array([(x + 3) & (1 << 64) - 1], np.uint64))[0]) >> 32

    def times_c(x):
        return x * int(cm._C) & M32

    for t, w in enumerate(words):
        topic = next((names[j] for j in range(t - 1, -1, -1) if len(words[j]) < cm.SHORT), none[0])
        one = names[t - 1] if t >= 1 else none[1]
        two = names[t - 2] if t >= 2 else none[2]
        both = int(cm.tx.mix(np.array([(one * 0x9E3779B97F4A7C15 + two + 7) & (1 << 64) - 1], np.uint64))[0])
        ctx = [top(topic), top(one), top(both)]
        data = w + (b" " if w else b"\n")
        for pos, byte in enumerate(data):
            last = [data[pos - k] if pos >= k else 0 for k in range(1, 5)]
            word = int(cm.word_hashes([data[:pos]])[0]) >> 32
            key2 = times_c(last[0] | last[1] << 8)
            key3 = times_c((last[0] | last[1] << 8 | last[2] << 16) ^ 0x5BD1E995)
            key4 = times_c(last[0] | last[1] << 8 | last[2] << 16 | last[3] << 24)
            value = last[0] << 8 | byte
            first = int(code.first[value])
            for step in range(first, first + int(code.length[value])):

                def slot(h, bits):
                    h ^= h >> 15
                    return (h * int(cm._E) & M32) >> 32 - bits ^ int(code.node[step])

                slots = [slot(h, n) for h, n in zip((key4, word, ctx[0] ^ key3, ctx[1] ^ word, ctx[2] ^ word), sizes)]
                yield t, step == first, slots, [slot(times_c(x), cm.OWN_BITS) for x in (word, key2)], int(code.bit[step])


def slow_score(text, model):
    """log2 probability of a text: plain loops over bits, steps after each block of tokens."""
    total, trust = 0.0, []
    for cells, doubt in zip(model.cells, cm.DOUBT):
        free = sum(int(c) < 256 for c in cells) / len(cells)
        trust.append(doubt - cm.SHARED * math.log(max(free, 1e-3)))
    w = [[float(x) for x in cm.START] for _ in range(cm.GATES)]
    own = [Counter(), Counter()]
    of_block = {}
    for k, (at, size) in enumerate(cm.blocks(len(text.split()) + 1)):
        of_block.update(dict.fromkeys(range(at, at + size), k))
    for _, block in itertools.groupby(slow_bits(text, model.code, model.sizes), key=lambda x: of_block[x[0]]):
        steps = []
        for _, is_first, slots, mine, bit in block:
            x, seen = [], []
            for k, s in enumerate(slots):
                odds, n = int(model.cells[k][s]) & 255, int(model.cells[k][s]) >> 8
                times = 2 ** (n / 8) - 1
                x.append((odds - 256 * (odds > 127)) / 12 * times / (times + trust[k]))
                seen.append(n)
            if is_first:
                gate = sum(seen[1] >= y for y in cm.KNOWN) + (seen[3] > 0) * (cm.GATES // 2)
            z = sum(a * b for a, b in zip(w[gate], x)) + own[0][mine[0]] + own[1][mine[1]]
            p = 1 / (1 + math.exp(-max(-12, min(12, z))))
            total += math.log2(p if bit else 1 - p)
            steps.append((gate, x, mine, bit - p))
        for gate, x, mine, err in steps:
            for j in (0, 1):
                own[j][mine[j]] += float(cm.OWN_RATES[j]) * err
            for k in range(len(x)):
                w[gate][k] += float(cm.RATE) * err * x[k]
    return total


def test_against_plain_loops():
    """Counts and scores are those of a bit-by-bit version."""
    rows = [t.encode() for _, t, _ in corpus(60)] + [b"", b" \n", "ÄÖ été\u2003x".encode()]
    model, counts = model_of(rows)
    slow = [np.zeros_like(c) for c in counts]
    for t in rows:
        for _, _, slots, _, bit in slow_bits(t, model.code, model.sizes):
            for k, s in enumerate(slots):
                slow[k][s, bit] += 1
    assert all(np.array_equal(a, b) for a, b in zip(slow, counts))
    texts = [b"", b"abc", rows[3], b"zz unseen \xc3\x89 " + rows[5], b"\x00 \xff", (rows[7] + b" ") * 40]
    assert cm.Reader(model).bits(texts) == pytest.approx([slow_score(t, model) for t in texts], rel=2e-4)


def test_in_small_parts(monkeypatch):
    """Counts and scores don't depend on how many words or tokens are worked on at a time."""
    rows = [t.encode() for _, t, _ in corpus(40)] + [b"", b"w" * 3000]
    model, counts = model_of(rows)
    bits = cm.Reader(model).bits(rows)
    monkeypatch.setattr(cm, "WORDS", 3)
    monkeypatch.setattr(cm, "TOKENS", 2)
    again, others = model_of(rows)
    assert all(np.array_equal(a, b) for a, b in zip(counts, others))
    assert cm.Reader(again).bits(rows) == pytest.approx(bits, rel=1e-5)


def test_words_of_batches(monkeypatch):
    """Words are counted as a dictionary counts them, and read from parts of batches, whatever their sizes."""
    texts = [t.encode() for _, t, _ in corpus(30)] + [b"", b" \n", b"A\x0bb\x0c\ra  B \xc3\x89", b"\x00 \xff"]
    counted = Counter()
    for b in cm._count_words(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])])):
        for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counted[w] += c
    assert counted == Counter(w for t in texts for w in [*t.lower().split(), b""])
    words = [b"", b"ab", b"c" * 50, b"", b"d", b"ef"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(words, pa.binary())], ["n", "word"])
    monkeypatch.setattr(cm, "STEP_BYTES", 40)
    for lo in range(6):
        n, size, data = map(np.concatenate, zip(*cm._words(iter([batch.slice(lo, 0), batch.slice(lo)]))))
        assert n.tolist() == list(range(lo, 6)) and size.tolist() == [len(w) + 1 for w in words[lo:]]
        assert data.tobytes() == b"".join(w + b" " if w else b"\n" for w in words[lo:])


def test_nothing_is_spread_over_the_bits_of_a_text(monkeypatch):
    """A byte's slots, gates and weights meet its bits slice by slice: what is repeated is less than a value a bit."""
    rows = [t.encode() for _, t, _ in corpus(200)] * 3
    model, _ = model_of(rows[:200])
    u, many, repeat = cm.units(rows), [0], np.repeat

    def counted(*args, **named):
        got = repeat(*args, **named)
        many[0] += got.size
        return got

    length = cm.spelled(u.size, u.data, model.code).length
    bits = int(np.add.reduceat(length, np.cumsum(u.size) - u.size)[u.of].sum())
    reader = cm.Reader(model)
    monkeypatch.setattr(np, "repeat", counted)
    reader.read(u)
    assert many[0] < bits


def test_probabilities_add_up():
    """Over all words of one byte, closed, and the end: less than one in sum, as the rest is longer."""
    model, _ = model_of([b"a b c a b", b"a c a b", b"d"])
    assert abs(sum(2.0**-n for n in model.code.length[:256]) - 1) < 1e-12
    r = cm.Reader(model)
    one = [bytes([v]) for v in range(256) if not bytes([v]).isspace() and not bytes([v]).isupper()]
    # each of them with an end; what follows the word is parted between the end and more words
    got = 2.0 ** r.bits([b"", *one])
    ends = 2.0 ** (r.bits([b"a"]) - r.read(cm.units([b"a"]))[:1])
    assert 0 < got.sum() < 1 and 0 < ends[0] < 1
    firsts = [2.0 ** r.read(cm.units([w]))[0] for w in (b"", *one)]
    assert 0.5 < sum(firsts) < 1


def test_better_than_counts_of_words(spark):
    """On held-out texts the score is above that of word counts, though new words are spelled."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    got = [r for r in cm.score(spark.read.parquet(path)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert any(r.n_known < r.n_tokens for r in got)


def test_empty(spark):
    assert cm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_before_predict_frequent_words(spark):
    """Each word fixes the next one, so the words before tell what their frequencies don't."""
    rng = np.random.default_rng(5)
    names = ["w%03d" % i for i in range(200)]
    rows = [(i, " ".join(names[(a + k) % 200] for k in range(30)), "k") for i, a in enumerate(rng.integers(0, 200, 400).tolist())]
    rows += [(10_000, " ".join(names[k] for k in range(30)), "k"), (10_001, " ".join(rng.permutation(names[:30])), "k")]
    by = {r.doc_id: r for r in cm.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by[10_000].score > 0.7 * by[10_001].score


def test_state_is_carried_through_a_text(spark):
    rows = corpus(60)
    rng = np.random.default_rng(7)
    part = " ".join("".join(rng.choice(list("stuvwxyz"), 6)) for _ in range(150))  # longer than 1,000 bytes
    once, often = (9_000, part, "k"), (9_001, " ".join([part] * 12), "k")
    model, _ = cm.fit(spark.createDataFrame(rows, SCHEMA))
    a, b = cm.Reader(model).bits([once[1].encode(), often[1].encode()])
    assert b > 0.75 * 12 * a


def test_sizes():
    """Tables grow with the number of distinct words, up to a bound."""
    assert cm.table_bits(10**6) > cm.table_bits(10**5) > cm.table_bits(10**3)
    assert max(cm.table_bits(10**12)) == cm.MOST_BITS


def test_very_long_text():
    model, _ = model_of([t.encode() for _, t, _ in corpus(40)])
    text = b" ".join(t.encode() for _, t, _ in corpus(40)) * 30 + b" " + b"w" * 100_000
    got = cm.Reader(model).bits([text, b"a"])
    assert np.isfinite(got).all() and got[1] == cm.Reader(model).bits([b"a"])[0]
