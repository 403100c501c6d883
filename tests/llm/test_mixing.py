from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, budget string"


def corpus(n=600):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((i, " ".join(["w"] * int(rng.integers(1, 60))), "en" if hot else str(rng.choice(["en", "de", "fr"])), "src1" if hot else f"src{rng.integers(0, 14)}", 1, "clash"))
    rows += [(5000, None, "de", "src2", 0, "c"), (5001, "", None, None, 0, "c"), (5002, "a b c", None, "odd", 0, "c"), (0, *rows[0][1:])]
    return rows


def brute(rows, hashes, plan):
    leaves = defaultdict(list)
    for (i, text, lang, source, *_), own in zip(rows, hashes):
        digits = "".join(c for c in (source or "") if c.isdigit())
        domain = "(none)" if not digits else "wide" if len(digits) > 1 else "core"
        leaves[(domain, lang or "(none)", source or "(none)")].append((own, i, len((text or "").split())))
    budgets = mixing.allocate({k: sum(x[2] for x in v) for k, v in leaves.items()}, plan)
    return leaves, budgets


def test_budgets_by_hand():
    f = mixing.split_budget
    assert f(100, {"a": (1, 1000), "b": (3, 1000)}) == {"a": 25, "b": 75}
    assert f(100, {"a": (1, 1000), "b": (3, 30)}) == {"a": 70, "b": 30}
    assert f(100, {"a": (1, 10), "b": (1, 20), "c": (2, 1000)}) == {"a": 10, "b": 20, "c": 70}
    assert f(100, {"a": (1, 10), "b": (1, 20)}) == {"a": 10, "b": 20}
    assert sum(f(100, {k: (1, 1000) for k in "abc"}).values()) == 100
    assert f(0, {"a": (1, 5)}) == {"a": 0} and f(5, {}) == {}
    # a shortage stays with its siblings before it reaches another domain
    plan = mixing.Plan(weights=(), share=0.5, max_epochs=1)
    got = mixing.allocate({("x", "en", "p"): 10, ("x", "en", "q"): 100, ("y", "en", "r"): 90}, plan)
    assert got == {("x", "en", "p"): 10, ("x", "en", "q"): 40, ("y", "en", "r"): 50}


def level_of(budget, children):
    """Shares of siblings by water-filling: the level at which what flows in is the budget, found by
    halving. Written without the operator's own rounds."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(c, w * mid) for w, c in children.values()) < budget:
            low = mid
        else:
            high = mid
    return {k: min(c, w * high) for k, (w, c) in children.items()}


def test_budgets_by_water_filling():
    rng = np.random.default_rng(17)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        children = {f"c{i}": (float(rng.integers(1, 7)), int(rng.integers(0, 400))) for i in range(n)}
        budget = int(rng.integers(0, 1500))
        got = mixing.split_budget(budget, children)
        assert sum(got.values()) == min(budget, sum(c for _, c in children.values()))
        assert all(0 <= got[k] <= c for k, (_, c) in children.items())
        want = level_of(min(budget, sum(got.values())), children)
        assert all(abs(got[k] - want[k]) < 1 + 1e-6 for k in children)


def test_tree_by_water_filling():
    """Every level of the tree shares what its parent got, by weight and room."""
    rng = np.random.default_rng(18)
    leaves = {(d, la, f"{d}{la}{s}"): int(rng.integers(1, 500)) for d in "xy" for la in ("de", "en") for s in range(3)}
    plan = mixing.Plan(weights=(("x", 3.0), ("x/en", 2.0), ("y/de/yde1", 4.0)), share=0.7, max_epochs=2)
    got, weights = mixing.allocate(leaves, plan), dict(plan.weights)
    assert sum(got.values()) == int(0.7 * sum(leaves.values()))
    for depth in (0, 1, 2):
        for path in {k[:depth] for k in leaves}:
            kids = sorted({k[depth] for k in leaves if k[:depth] == path})
            total = lambda table, *p: sum(v for k, v in table.items() if k[: len(p)] == p)
            children = {c: (weights.get("/".join((*path, c)), 1.0), 2 * total(leaves, *path, c)) for c in kids}
            want = level_of(total(got, *path), children)
            assert all(abs(total(got, *path, c) - want[c]) < 1 + 1e-6 for c in kids)


def test_very_long_text(spark):
    rows = [(1, "w " * 200_000, "en", "src1", 0, "c"), (2, "a b", "en", "src1", 0, "c"), (3, "a b c", "en", "src2", 0, "c")]
    got = {r.row.doc_id: r.copies for r in mixing.with_copies(spark.createDataFrame(rows, SCHEMA), mixing.Plan(weights=(), share=1.0, max_epochs=1)).collect()}
    assert got[1] == 1 and got[3] == 1


def test_against_brute_force(spark):
    rows = corpus()
    for plan in (mixing.Plan(), mixing.Plan(share=0.4, max_epochs=1, seed=3), mixing.Plan(share=5.0, max_epochs=3)):
        df = spark.createDataFrame(rows, SCHEMA)
        hashes = [r[0] for r in df.select(F.xxhash64("doc_id", "text")).collect()]
        leaves, budgets = brute(rows, hashes, plan)
        got = defaultdict(list)
        for r in mixing.with_copies(df, plan).collect():
            got[(r.domain, r.lang, r.source)].append((r.row.doc_id, r.copies))
            assert r.budget == budgets[(r.domain, r.lang, r.source)]
        assert got.keys() == leaves.keys()
        flat = [(k, *x) for k, v in leaves.items() for x in v]
        ats = spark.createDataFrame([(plan.seed, budgets[k] // max(1, sum(x[2] for x in leaves[k])), own) for k, own, *_ in flat], "s int, w long, own long")
        ats = [r[0] for r in ats.select(F.xxhash64("s", "w", "own")).collect()]
        order = defaultdict(list)
        for (k, own, i, n), at in zip(flat, ats):
            order[k].append(((at % (1 << 64) >> 40) % mixing.BUCKETS, at, own, i, n))
        for k, docs in order.items():
            total = sum(x[4] for x in docs)
            whole, rest = divmod(budgets[k], total) if total else (0, 0)
            want, run, going = [], 0, rest > 0
            for *_, i, n in sorted(docs):
                run += n
                going = going and run <= rest
                want.append((i, whole + going))
            assert sorted(want) == sorted(got[k]), k


def test_taken_rows_keep_their_columns(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = mixing.mix(df)
    assert out.columns == df.columns
    n = sum(len((r.text or "").split()) for r in df.collect())
    m = sum(len((r.text or "").split()) for r in out.collect())
    assert 0.9 * n < m <= n
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("text is null")).count() == 0


def test_cut_among_repeated_rows(spark):
    """Of rows that repeat as many are taken as the budget holds."""
    rows = [(1, "a b c", "en", "src1", 5, "x")] * 10
    plan = mixing.Plan(weights=(), share=0.5, max_epochs=1)
    got = mixing.with_copies(spark.createDataFrame(rows, SCHEMA), plan).collect()
    assert sorted(r.copies for r in got) == [0] * 5 + [1] * 5
    assert sum(3 * r.copies for r in got) <= got[0].budget
