"""WARC archives in seekable Zstandard bundles.

Records are gathered into independent Zstandard frames; a bundle ends in a skippable
frame that holds the seek table (the published seekable format). An index maps every
record identifier to its bundle, frame and offset inside the frame, so one record is read
by decompressing one frame. Records whose payload equals that of a later page are
``revisit`` records, written without payload.

Each task writes bundles of its own, of bounded size, under a fresh name, and moves them
into place when they are whole; the index lists only bundles of tasks that ended well, so
a task that runs again after a lost executor leaves at most a stray file.

Null html is an empty payload. Rows with a null page id are ``response`` records. Rows
that repeat an id and a payload are each written. Pages have no time of their own, so all records
have the date ``DATE`` and archives of equal pages are equal. A payload is held whole, as Spark
holds it (2 GB at most, which is also within the 32-bit sizes of the seek table); a frame holds
``FRAME_BYTES`` and one record.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.runtime import cut, ensure_checkpoint_dir

#: Smallest payload, in bytes, of which copies become revisits.
LEAST_SHARED = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id string, bundle string, frame int, frame_at long, frame_bytes int, record_at int, record_bytes int"


class Store:
    """Files by path or URI: local ones directly, others through Arrow's file systems."""

    def __init__(self, root: str) -> None:
        at = urlparse(root)
        self.fs = None
        self.root = unquote(at.path) if at.scheme in ("", "file") else root
        if at.scheme not in ("", "file"):
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)

    def write(self, name: str, data: list[bytes]) -> None:
        path, part = f"{self.root}/{name}", f"{self.root}/.{name}.part"
        if self.fs is None:
            os.makedirs(self.root, exist_ok=True)
            with open(part, "wb") as f:
                f.writelines(data)
            os.replace(part, path)
        else:
            self.fs.create_dir(self.root)
            with self.fs.open_output_stream(part) as f:
                for x in data:
                    f.write(x)
            self.fs.move(part, path)

    def open(self, name: str):
        path = f"{self.root}/{name}"
        return open(path, "rb") if self.fs is None else self.fs.open_input_file(path)


class Bundle:
    """Frames of one bundle and where its records lie; at most ``BUNDLE_BYTES`` and one frame."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.rows: list[tuple] = []
        self.at = 0
        self.open: list[bytes] = []
        self.waiting: list[tuple[str, int, int]] = []
        self.size = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.waiting.append((record_id, self.size, len(record)))
        self.open.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.open:
            return
        frame = self.packer.compress(b"".join(self.open))
        self.rows += [(i, len(self.table), self.at, len(frame), a, n) for i, a, n in self.waiting]
        self.table.append((len(frame), self.size))
        self.frames.append(frame)
        self.at += len(frame)
        self.open, self.waiting, self.size = [], [], 0

    def footer(self) -> bytes:
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(f) -> list[tuple[int, int]]:
    """(offset, compressed size) of every frame, from the bundle's footer."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    f.seek(end - 9 - 8 * n)
    raw, at, out = f.read(8 * n), 0, []
    for i in range(n):
        size = struct.unpack_from("<I", raw, 8 * i)[0]
        out.append((at, size))
        at += size
    return out


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _line(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-cased names), HTTP headers and payload (None for a revisit) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(named["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    named["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    named["payload"] = payload if named["warc-type"] == "response" else None
    return named


def _page(rid: str) -> int | None:
    v = rid.removeprefix("<urn:page:").removesuffix(">")
    return None if v == "none" else int(v)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, refers_to)``; only ids and digests are grouped, and html moves once."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("size"))
    shared = keyed.filter((F.col("size") >= LEAST_SHARED) & F.col("page_id").isNotNull())
    first = shared.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"))
    first = first.filter("low < refers_to").select("digest", "refers_to")
    later = shared.join(first, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return (
        rows.withColumn("digest", F.sha1("payload"))
        .join(later, ["page_id", "digest"], "left")
        .select("page_id", "url", "payload", "refers_to")
    )


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write all pages under ``root``; returns the index (see ``INDEX``), materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, made = Store(root), Bundle()

        def finish(b: Bundle):
            b.close_frame()
            if not b.rows:
                return
            name = f"{uuid.uuid4().hex}.warc.zst"
            store.write(name, [*b.frames, b.footer()])
            for at in range(0, len(b.rows), 5000):
                cols = list(zip(*b.rows[at : at + 5000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array([name] * len(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[3:]]],
                    ["record_id", "bundle", "frame", "frame_at", "frame_bytes", "record_at", "record_bytes"],
                )

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, refers = (b.column(k)[i].as_py() for k in range(4))
                made.add(record_id(page), make_record(page, url, payload, refers))
                if made.at >= BUNDLE_BYTES:
                    yield from finish(made)
                    made = Bundle()
        yield from finish(made)

    return cut(with_revisits(pages).mapInArrow(run, INDEX))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(index: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Every record of the index, by seeking to its frame; one row a record (see ``READ``).

    A response's digest is computed from its payload and must equal its header. A frame
    is decompressed once for all its records. Without ``payloads`` that column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, unpack = Store(root), zstandard.ZstdDecompressor()
        name = f = frames = frame = None
        out, size = [], 0

        def batch():
            return pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

        for b in batches:
            for x in b.to_pylist():
                if x["bundle"] != name:
                    if f is not None:
                        f.close()
                    name, frame = x["bundle"], None
                    f = store.open(name)
                    frames = seek_table(f)
                if x["frame"] != frame:
                    frame = x["frame"]
                    at, n = frames[frame]
                    if (at, n) != (x["frame_at"], x["frame_bytes"]):
                        raise ValueError("index and seek table differ")
                    f.seek(at)
                    data = unpack.decompress(f.read(n))
                r = parse_record(data[x["record_at"] : x["record_at"] + x["record_bytes"]])
                digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                body = r["payload"]
                if body is not None and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError("a payload doesn't have its digest")
                out.append(
                    {"page_id": _page(r["warc-record-id"]), "url": r.get("warc-target-uri"), "payload_bytes": int(r["http"]["content-length"]) if body is None else len(body), "payload_digest": digest, "record_type": r["warc-type"], "refers_to": _page(r["warc-refers-to"]) if "warc-refers-to" in r else None, "payload": body if payloads else None}
                )
                size += len(body or b"") if payloads else 200
                if size >= 4 << 20:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame", "record_at")
    return dealt.mapInArrow(run, READ)


def read_record(root: str, row: dict) -> dict:
    """One record by its index row: one seek, one frame."""
    store = Store(root)
    with store.open(row["bundle"]) as f:
        at, n = seek_table(f)[row["frame"]]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(n))
    return parse_record(data[row["record_at"] : row["record_at"] + row["record_bytes"]])


def new_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
