from collections import Counter

from quillstone.llm import quality

SCHEMA = "doc_id long, text string, q string"


def brute(text):
    text = text or ""
    w = text.encode().split()
    w = [x.decode() for x in w]
    lines = [x for x in text.split("\n") if x.encode().split()]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(x) for x in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, t in enumerate(tri) if c[t] > 1 for k in range(3)}),
    }


CASES = [None, "", " \n ", "a", "a b c", "a b c a b c", "x x x x x", "l\nl\n \n\nl", "a#*$ %&|<> é è z", "a b c d a b c e b c d\x0b\x0cq\x1cr", "日本 語 日本 語 日本 語", "the cat " * 3000]


def test_features_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(CASES)], SCHEMA)
    report = quality.quality_report(df)
    assert report.columns == [*df.columns, "_q"]  # the table's own q stays
    rows = {r.doc_id: r for r in report.collect()}
    for i, t in enumerate(CASES):
        assert rows[i].q == "clash"
        got = rows[i]["_q"].asDict()
        for k, v in brute(t).items():
            assert got[k] == v, (i, k, t)


def test_cascade_keeps_clean_rows_in_any_order(spark):
    clean = " ".join(f"word{i} and other{i * 7}" for i in range(60))
    rows = [(1, clean, "k"), (2, "###", "k"), (3, "same words here " * 50, "k"), (1, clean, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = quality.keep_quality(df)
    assert kept.columns == df.columns
    assert [r.doc_id for r in kept.collect()] == [1, 1]
    ranked = quality.rank_rules(df)
    assert {x["rule"].name for x in ranked} == {r.name for r in quality.RULES}
    assert quality.keep_quality(df.limit(0)).count() == 0
