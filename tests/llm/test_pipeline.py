import re
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline as cp
from quillstone.llm import mixing, pieces, pii
from tests.llm.test_simhash import kept_by_brute_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 8)))) for _ in range(500)]
    rows = []
    for i in range(90):
        t = " ".join(rng.choice(vocab, int(rng.integers(60, 160))))
        if i % 9 == 0:
            t += f" write to anna.{i}@mail1.example.com or +1 (415) 555-{1000 + i}"
        rows.append((i, t, ["en", "de"][i % 2], f"src{i % 13}", len(t)))
    rows += [(200, rows[4][1], "en", "src3", 1), (201, rows[5][1] + " more", "en", "src3", 1), (202, "short", "en", "src1", 5), (203, None, None, None, None), (204, "### " * 80, "en", "src1", 1)]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "source_mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{i}")
        after.append(docs.collect())
    # clean documents stay, junk goes
    assert {r.doc_id for r in after[0]} == {r[0] for r in rows} - {202, 203, 204}
    assert {r.doc_id for r in after[1]} == kept_by_brute_force([(r.doc_id, r.text) for r in after[0]])[0]
    assert 200 not in {r.doc_id for r in after[1]}
    # base personal data is gone, all else is as it was
    before = {r.doc_id: r.text for r in after[1]}
    for r in after[2]:
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    taken = Counter(r.doc_id for r in after[3])
    want = mixing.with_copies(spark.read.parquet(f"{tmp_path}/2")).collect()
    assert taken == Counter({r.row.doc_id: r.copies for r in want if r.copies})
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in after[3]}
    assert Counter(r.doc_id for r in after[4]) == taken
    for r in after[4]:
        assert r.ids == model.encode(texts[r.doc_id]) and r.round_trip
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, r.ids) for r in after[4])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
