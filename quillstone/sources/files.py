"""Tables, objects and edge lists in files, by Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = T.StructType([T.StructField("path", T.StringType()), T.StructField("url", T.StringType())])


def write_csv(df: DataFrame, path: str, append: bool = False, header: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("header", header).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows that fit the schema; others are dropped."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Lines ``u, v``."""
    edges.select(F.concat_ws(", ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", r",\s*")
    return spark.read.text(path).select(F.get(part, F.lit(0)).try_cast("long").alias("src"), F.get(part, F.lit(1)).try_cast("long").alias("dst")).filter("src is not null and dst is not null")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``(path, url)`` of files to fetch."""
    return read_csv(spark, path, LINKS)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The instance at ``path``, made and written there if it isn't yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)


def listed(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``(path, length)`` of all files below a folder whose names end so; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length")


def folders(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()


def graphs(files: DataFrame, read: Callable[[str], DataFrame], by_size: bool = True, log: Callable[[str], None] = print) -> Iterator[tuple[str, DataFrame]]:
    """Each file's graph, smallest first; files that are too large or unreadable are reported and skipped."""
    for r in files.orderBy("length" if by_size else "path").toLocalIterator():
        try:
            yield r.path, read(r.path)
        except (ValueError, AnalysisException) as e:
            log(f"{r.path}: {e}")


def download(url: str, path: str, opener: Callable | None = None) -> str:
    """Fetch a file unless it is there; it takes its name only when it is whole."""
    import os
    import shutil
    from urllib.request import urlopen

    if os.path.exists(path):
        return "already exists"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with (opener or urlopen)(url) as src, open(f"{path}.part", "wb") as out:
        shutil.copyfileobj(src, out)
    os.replace(f"{path}.part", path)
    return "downloaded"


def fetch_links(spark: SparkSession, links: str, folder: str, opener: Callable | None = None, log: Callable[[str], None] = print) -> dict[str, str]:
    """Fetch every file of a list (see ``read_links``) in turn, below ``folder``; what became of each,
    by path. One that fails is reported and the next is fetched."""
    out = {}
    for r in read_links(spark, links).toLocalIterator():
        try:
            out[r["path"]] = download(r["url"], f"{folder}/{r['path']}", opener)
        except OSError as e:
            out[r["path"]] = "failed"
            log(f"{r['url']}: {e}")
    return out
