import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from quillstone.llm import pieces, simhash

ODD = ["", " ", "  ", "a", "▁", "▁▁ a", "Hello  wörld\n\tx ▁ y 日本 <s> </s> 🤖 ", "<0x0A>", "\n", "\n\n  \n x", "a\u0000b", "aaaa" * 50, "é é", "\r\n\x0b", "<unk>"]
ODD += [" " * k + "the  x" + " " * (k // 2) for k in range(1, 70, 3)]
SCHEMA = "doc_id long, text string, ids string"


def test_parity_with_the_model(spark):
    raw = open(pieces.MODEL, "rb").read()
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    got = pieces.coder(raw).encode(ODD)
    assert [list(x) for x in got] == model.encode(ODD)
    assert pieces.coder(raw).decode(got) == model.decode([list(map(int, x)) for x in got])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(99, None, "c"), (0, "", "c"), (98, "long text " * 9000, "c")], SCHEMA)
    out = pieces.encode(df, raw)
    rows = out.collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r.doc_id < 98:
            assert r.ids == model.encode(ODD[r.doc_id]) and r.n_pieces == len(r.ids)
            assert r.round_trip == ("▁" not in ODD[r.doc_id])
    back = {r.doc_id: r.text for r in pieces.decode(out, raw).collect()}
    assert back[98] == "long text " * 9000 and back[99] == "" and back[3] == "a"
    assert pieces.encode(df.limit(0), raw).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    raw = open(pieces.MODEL, "rb").read()
    monkeypatch.setattr(pieces, "CACHED_WORDS", 5)
    c, model = pieces.Coder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in ODD:
        assert [list(x) for x in c.encode([t, "a b\nc"])] == model.encode([t, "a b\nc"])


def test_fast_normaliser_is_the_rebuilt_one():
    c = pieces.coder(open(pieces.MODEL, "rb").read())
    for t in ODD[1:]:
        assert c.normal(t) == c.whole.normalizer.normalize_str(t)


def _field(number, kind, v):
    head = bytes([number << 3 | kind]) if number < 16 else bytes([(number & 15) << 3 | 0x80 | kind, number >> 4])
    return head + (bytes([len(v)]) + v if kind == 2 else bytes([v]) if kind == 0 else v)


def hand_made(kind, remove_extra=1):
    """A small model written by hand: byte pieces, letters and a few words with scores."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    rows += [(p, -1.0 - 0.137 * i, 1) for i, p in enumerate(["▁the", "▁th", "he", "▁t", "in", "ing", "▁a", "an", "nd", "▁and"])]
    rows += [(p, -5.0 - 0.0173 * i, 1) for i, p in enumerate("▁abcdefghint")]
    out = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in rows)
    out += _field(2, 2, _field(3, 0, kind) + _field(35, 0, 1) + _field(40, 0, 0))
    return out + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, remove_extra) + _field(5, 0, 1))


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("extra", [0, 1])
def test_other_models(kind, extra):
    raw = hand_made(kind, extra)
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["the thing and an ant", "hand in hand", " a  the ", "xyz é", "", "thethethe\nand", "an" * 40]
    assert [list(x) for x in pieces.Coder(raw).encode(texts)] == model.encode(texts)


def test_other_operators_tasks_give_the_coder_back():
    """Workers are used again by the pipeline's other stages, which need their memory."""
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"a b c d e f"])], ["id", "text"])
    for run, batches in ((simhash._sketches, [batch]), (simhash._sets, [batch]), (simhash._search(2, simhash.WIDTH, 1, np.uint16), [])):
        held = pieces.coder(pieces.read_model(None))
        assert pieces.coder(pieces.read_model(None)) is held
        list(run(iter(batches)))
        assert not pieces._CODERS
    assert pieces.coder(pieces.read_model(None)).decode(held.encode(["give it back"])) == ["give it back"]
