import os

import numpy as np
import xxhash

from quillstone.llm import simhash
from quillstone.runtime import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts):
    fps = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        if not w:
            fps[i] = 0
            continue
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return fps


def components(fps):
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(3)
    vocab = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choice(vocab, 300)) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):  # chains of small edits
        w = t.split()
        for k in range(6):
            w[k * 40] = "edit%d" % k
            texts.append((100 + 10 * i + k, " ".join(w)))
    texts += [(200, base[3].upper()), (201, ""), (202, None), (203, " \n\t"), (204, "one"), (205, "one two"), (206, "é É x")]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA)).collect()
    fps = brute(texts)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == components(fps)
    assert len(set(components(fps).values())) < len(texts) - 10


def test_very_long_text():
    """Votes are added up over stretches of shingles."""
    rng = np.random.default_rng(4)
    for n in (1 << 15, (1 << 15) + 2, 70_001):
        t = " ".join("w%d" % x for x in rng.integers(0, 50, n))
        assert simhash.fingerprint(t.encode()) == brute([(0, t)])[0]


def test_planted_distances_and_hot_group(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40)
    fps = {int(s) for s in seeds}
    for s in seeds[:20]:
        for r in (1, 2, 3, 4):
            fps.add(int(s) ^ sum(1 << int(b) for b in rng.choice(63, r, replace=False)))
    hot = int(seeds[0])
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert all((r.u ^ r.v).bit_count() <= 3 for r in got)
    assert len(got) < 6 * 10 * len(fps)  # links join parts; they aren't all pairs
    from quillstone.operators.components import connected_components

    comp = connected_components(spark.createDataFrame([(r.u, r.v) for r in got], "u long, v long"))
    found = {r.v: r.component for r in comp.collect()}
    want = components({x: x for x in fps})
    assert {x: found.get(x, x) for x in fps} == want


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    """``(id, text)`` that stay: links at a similarity of 0.8 between all pairs of texts."""
    texts = sorted({t or "" for i, t in rows if i is not None})
    sets, part = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = part[a], part[b]
                part = [x if p == y else p for p in part]
    of = dict(zip(texts, part))
    best = {}
    for i, t in rows:
        if i is not None:
            best.setdefault(of[t or ""], set()).add((i, t or ""))
    return {min(v)[0] for v in best.values()}, len(best)


def test_similar_texts_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocab = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(25):
        w = rng.choice(vocab, 300).tolist()
        rows.append((10 * i, " ".join(w)))
        for k, edits in enumerate((1, 3, 6, 12, 30)):  # similarities from 0.97 down to 0.3
            x = list(w)
            for at in rng.choice(300, edits, replace=False):
                x[at] = "edit"
            rows.append((10 * i + 1 + k, " ".join(x)))
    passage = " ".join(rng.choice(vocab, 100))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(vocab, 100))) for i in range(40)]  # shared by many, similar to none
    rows += [(2000, ""), (2001, None), (2002, "one"), (2003, "ONE"), (2004, "x " * 30_000), (2005, "x " * 29_000)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA))
    ids, n = kept_by_brute_force(rows)
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == n and set(got) == ids


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(13)
    vocab = ["w%d" % i for i in range(400)]
    w = rng.choice(vocab, 200).tolist()
    rows = []
    for i in range(3000):
        x = list(w)
        x[int(rng.integers(0, 200))] = f"e{i}"
        rows.append((i, " ".join(x), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    texts = df.selectExpr("doc_id AS id", "cast(text AS binary) AS text")
    links = simhash.similar_texts(texts).collect()
    assert len(links) < 30 * len(rows)  # they join the copies; they aren't all pairs
    assert [r.doc_id for r in simhash.drop_near_duplicates(df).collect()] == [0]


def test_parts_of_links(spark, monkeypatch):
    """Contracted in one partition, and in many whose stars are joined."""
    rng = np.random.default_rng(17)
    links = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (350, 2))] + [(900 + i, 901 + i) for i in range(60)] + [(2000, 2000)]
    part = {x: x for e in links for x in e}
    for _ in part:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    for each in (simhash.ROWS_EACH, 64):
        monkeypatch.setattr(simhash, "ROWS_EACH", each)
        got = simhash.parts_of(spark.createDataFrame(links, "u long, v long").repartition(8)).collect()
        assert len(got) == len(part) and {r.v: r.component for r in got} == part
    assert simhash.parts_of(spark.createDataFrame([], "u long, v long")).count() == 0


def test_small_rounds_leave_few_files(spark):
    """Links and parts are few however many partitions there are; each file forks a process."""
    folder = spark._jvm.java.net.URI(ensure_checkpoint_dir(spark)).getPath()
    rng = np.random.default_rng(18)
    w = rng.choice(["w%d" % i for i in range(300)], 200).tolist()
    rows = [(i, " ".join(w[:i] + ["edit"] + w[i:]) if i < 30 else " ".join(rng.permutation(w)), "en", "s", 1) for i in range(60)]
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    files = lambda: sum(x.startswith("part-") for _, _, names in os.walk(folder) for x in names)
    before = files()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
        assert {r.doc_id for r in kept.collect()} == kept_by_brute_force([r[:2] for r in rows])[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert files() - before < 32 * 20


def test_rows_that_share_an_id(spark):
    """An unlike text under the id of a copy stays."""
    rng = np.random.default_rng(14)
    a, b = (" ".join(rng.choice(["w%d" % i for i in range(300)], 200)) for _ in "ab")
    rows = [(1, a, "en", "x", 1), (1, b, "en", "y", 1), (2, a + " more", "en", "x", 1)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b)])


def test_empty_repeats_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0
    rows = [(1, "a b c d", "en", "x", 7, "z"), (1, "a b c d", "en", "x", 7, "z"), (2, "a b c d", None, None, None, "y"), (None, "a b c d", "en", "x", 1, "n")]
    assert simhash.drop_near_duplicates(none).count() == 0
    df = spark.createDataFrame([(*r, "s", "r") for r in rows], SCHEMA + ", fp string, key string, row string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
