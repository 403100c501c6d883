import hashlib
import io

import zstandard

from quillstone.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>" + "long enough é " * 100


def pages(spark):
    rows = [(i, f"http://x/{i}", f"page {i} " + "y" * (50 * i)) for i in range(40)]
    rows += [(100, "u", BIG), (101, "u\r\nX: y", BIG), (102, None, BIG), (103, "u", "small"), (104, "u", "small")]
    rows += [(105, "u", None), (106, "u", ""), (None, "u", BIG), (100, "u", BIG), (107, "u", "\r\n\r\nodd\r\n" * 200)]
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_round_trip_and_revisits(spark):
    df = pages(spark)
    root = warc.new_root(spark)
    index = warc.write_archives(df, root)
    got = warc.read_archives(index, root).collect()
    assert len(got) == df.count()
    html = {r.page_id: (r.html or "").encode() for r in df.collect() if r.page_id is not None}
    for r in got:
        body = BIG.encode() if r.page_id is None else html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        want = 102 if r.page_id in (100, 101) else None
        assert r.refers_to == want and r.record_type == ("response" if want is None else "revisit")
        assert r.payload == (body if want is None else None)
    row = next(x.asDict() for x in index.collect() if x.record_id == "<urn:page:7>")
    one = warc.read_record(root, row)
    assert one["payload"] == html[7] and one["warc-target-uri"] == "http://x/7"


def test_bundles_are_plain_zstandard(spark):
    root = warc.new_root(spark)
    index = warc.write_archives(pages(spark), root).collect()
    store = warc.Store(root)
    for name in {r.bundle for r in index}:
        with store.open(name) as f:
            n = len(warc.seek_table(f))
            f.seek(0)
            whole = b"".join(zstandard.ZstdDecompressor().read_to_iter(f, read_size=1 << 16)) if n == 1 else b""
        assert n == 1 + max(r.frame for r in index if r.bundle == name)
        assert whole == b"" or whole.startswith(b"WARC/1.1")


def test_empty(spark):
    root = warc.new_root(spark)
    index = warc.write_archives(spark.createDataFrame([], SCHEMA), root)
    assert warc.read_archives(index, root).count() == 0


def test_frames_and_records_longer_than_one(monkeypatch):
    """Records fill frames of bounded size; a longer one closes its frame; each is read by one seek."""
    monkeypatch.setattr(warc, "FRAME_BYTES", 600)
    made = warc.Bundle()
    bodies = [b"a" * 10, b"b" * 5000, b"", b"c" * 200, b"d" * 200, b"\r\n\r\n", b"e" * 700]
    for i, x in enumerate(bodies):
        made.add(warc.record_id(i), warc.make_record(i, "http://x", x, None))
    made.close_frame()
    made.close_frame()  # an empty frame isn't written
    f = io.BytesIO(b"".join([*made.frames, made.footer()]))
    table = warc.seek_table(f)
    assert len(table) == len(made.frames) > 3 and [r[0] for r in made.rows] == [warc.record_id(i) for i in range(len(bodies))]
    for i, (_, frame, at, n, begin, size) in enumerate(made.rows):
        assert table[frame] == (at, n)
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(n))
        assert warc.parse_record(data[begin : begin + size])["payload"] == bodies[i]
        assert len(data) < 600 + max(len(x) for x in bodies) + 500
