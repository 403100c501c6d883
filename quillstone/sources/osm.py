"""OpenStreetMap road graphs from files in the protobuf format.

A data source reads raw tables: ``spark.read.format("osm").option("table", "nodes" | "ways")``
after ``register(spark)``, from a path or URI that Arrow's file systems know (several are parted
by commas). Files are sequences of independent blocks; the planner reads their headers, and every
task the blocks of a stretch of a file. ``roads`` joins the tables to nodes and edges.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstone.functions.geo import RADIUS
from quillstone.runtime import cut

#: Least bytes of a file that a task reads, but for a file's last.
STRETCH = 16 << 20


class TooLarge(ValueError):
    """A graph has more edges than the reader was told to take."""


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


def _packed(b: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        x, i = _varint(b, i)
        out.append((x >> 1) ^ -(x & 1) if signed else x)
    return out


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def stretches(path: str) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of a file, each of whole blocks and of ``STRETCH`` bytes or little more; only the
    headers of blocks are read."""
    fs, inner = FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        size, start, at = f.size(), 0, 0
        while at + 4 <= size:
            f.seek(at)
            n = struct.unpack(">I", f.read(4))[0]
            at += 4 + n + dict(_fields(f.read(n)))[3]
            if at - start >= STRETCH or at + 4 > size:
                yield start, at
                start = at


def blocks(data: bytes) -> Iterator[bytes]:
    """Unpacked data blocks of a stretch."""
    i = 0
    while i + 4 <= len(data):
        n = struct.unpack(">I", data[i : i + 4])[0]
        head = dict(_fields(data[i + 4 : i + 4 + n]))
        i += 4 + n
        blob = dict(_fields(data[i : i + head[3]]))
        i += head[3]
        if head[1] == b"OSMData":
            yield blob[1] if 1 in blob else zlib.decompress(blob[3])


def _zig(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def rows_of(block: bytes, table: str) -> Iterator[tuple]:
    """A block's nodes (id, longitude, latitude), or its ways (id, node ids, tags)."""
    strings, groups, unit, lat0, lon0 = [], [], 100, 0, 0
    for k, v in _fields(block):
        if k == 1:
            strings = [x.decode() for _, x in _fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            unit = v
        elif k == 19:
            lat0 = v
        elif k == 20:
            lon0 = v
    for g in groups:
        for kind, v in _fields(g):
            if (kind == 3) != (table == "ways"):
                continue
            f = defaultdict(list)
            for k, x in _fields(v):
                f[k].append(x)
            if kind == 2:  # dense nodes
                ids, lats, lons = (_running(_packed(f[k][0], True)) for k in (1, 8, 9))
                yield from ((i, 1e-9 * (lon0 + unit * lo), 1e-9 * (lat0 + unit * la)) for i, la, lo in zip(ids, lats, lons))
            elif kind == 1:
                yield _zig(f[1][0]), 1e-9 * (lon0 + unit * _zig(f[9][0])), 1e-9 * (lat0 + unit * _zig(f[8][0]))
            elif kind == 3:
                keys, vals = (_packed(b"".join(f[k])) for k in (2, 3))
                yield f[1][0], _running(_packed(b"".join(f[8]), True)), {strings[a]: strings[b] for a, b in zip(keys, vals)}


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths, self.table = options["path"].split(","), options.get("table", "nodes")

    def partitions(self) -> list[Stretch]:
        return [Stretch(p, *x) for p in self.paths for x in stretches(p)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        fs, inner = FileSystem.from_uri(partition.path)
        with fs.open_input_file(inner) as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        for block in blocks(data):
            yield from rows_of(block, self.table)


class Osm(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm"

    def schema(self) -> str:
        return "way long, refs array<long>, tags map<string, string>" if self.options.get("table", "nodes") == "ways" else "key long, lon double, lat double"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Osm)


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance of places in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def roads(spark: SparkSession, path: str, require: dict[str, list[str]] | None = None, merge_ways: bool = True, max_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(key, lon, lat)`` of nodes in use, and edges ``(src, dst, length)`` along the ways that match:
    of each required key one value must. ``merge_ways`` joins what lies between ends and crossings
    to one edge. References to nodes that aren't in the file are left out. More than ``max_size``
    edges raise ``TooLarge``.
    """
    register(spark)
    load = lambda t: spark.read.format("osm").option("table", t).load(path)
    ways = load("ways")
    for k, values in (require or {}).items():
        ways = ways.filter(F.col("tags")[k].isin(*values))
    refs = ways.select("way", F.posexplode("refs").alias("pos", "key"))
    uses = refs.groupBy("key").agg(F.count("*").alias("uses"))
    placed = refs.join(load("nodes"), "key").join(uses, "key")
    w = Window.partitionBy("way").orderBy("pos")
    before = lambda c: F.lag(c).over(w)
    steps = placed.select(
        "way", "pos", "key", before("key").alias("from"), metres(before("lon"), before("lat"), F.col("lon"), F.col("lat")).alias("step"),
        (F.lit(not merge_ways) | (F.col("uses") > 1) | F.lead("key").over(w).isNull()).alias("ends"),
    )
    steps = steps.filter("`from` is not null")
    part = F.coalesce(F.sum(F.col("ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = steps.withColumn("part", part).groupBy("way", "part").agg(F.min_by("from", "pos").alias("src"), F.max_by("key", "pos").alias("dst"), F.sum("step").alias("length"))
    edges = cut(edges.select("src", "dst", "length"))
    if max_size is not None and edges.limit(max_size + 1).count() > max_size:
        raise TooLarge(f"more than {max_size} edges")
    used = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    return load("nodes").join(used, "key"), edges
