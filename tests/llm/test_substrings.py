import hashlib

import numpy as np
import pytest

from quillstone.llm import substrings

SCHEMA = "doc_id long, text string, runs string"


def brute(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            if s in seen:
                gone[p : p + n] = True
            seen.add(s)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def texts():
    rng = np.random.default_rng(6)
    vocab = ["w%d" % i for i in range(400)] + ["é", "日本"]

    def prose(n):
        return " ".join(rng.choice(vocab, n))

    passage, other = prose(60), prose(25)
    out = [prose(int(rng.integers(1, 120))) for _ in range(40)]
    out += [prose(10) + passage + prose(20) for _ in range(8)]
    out += [prose(30) + passage[k : k + 100 + k] + prose(5) for k in range(0, 60, 7)]
    out += [other + prose(3) + other + prose(2) + other, "a" * 250, "a" * 99, "a" * 100, "ab" * 300, "xyz " * 200]
    out += [out[3], out[3] + "!", "?" + out[41], out[42][:150], "", None, passage + passage, prose(2000)]
    edit = list(out[45])
    edit[40] = "#"
    return out + ["".join(edit)]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 333])
def test_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(substrings, "SLICE", slice_bytes)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts())]
    got = substrings.remove_repeats(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeated_and_null_ids(spark):
    t = "0123456789" * 5 + "abcdefghij" * 6
    rows = [(4, t, "x"), (4, t, "x"), (None, t + "null", "x"), (5, t, "x"), (6, "z", "x"), (6, t, "x")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.n_removed)
    assert by[None] == [0] and by[4] == [110, 110] and by[5] == [110] and sorted(by[6]) == [0, 110]
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
