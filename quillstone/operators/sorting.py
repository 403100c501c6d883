"""Orders that are computed only as far as they are read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillstone.runtime import cut


def smallest(df: DataFrame, keys: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows; plans as one bounded heap a task and a merge, without a full sort."""
    return df.orderBy(*keys).limit(k)


def incremental(df: DataFrame, keys: list[Column | str], ascending: bool = True, first: int = 64) -> Iterator[Row]:
    """Rows in order, pulled: a cheap prefix, then the sorted rest a partition at a time.

    Every row comes once, however many share their keys: rows are numbered in a written copy,
    the number breaks ties, and the rest is what the prefix doesn't name.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    keys = keys if ascending else [k.desc() for k in keys]
    own = "__place_of_row"
    given, row = cut(df.withColumn(own, F.monotonically_increasing_id())), Row(*df.columns)
    head = smallest(given, [*keys, own], first).collect()
    yield from (row(*x[:-1]) for x in head)
    if len(head) == first:
        rest = given.filter(~F.col(own).isin([x[-1] for x in head])) if head else given
        for x in rest.orderBy(*keys, own).toLocalIterator(prefetchPartitions=True):
            yield row(*x[:-1])


def counting_sort(df: DataFrame, key: str, position: str, seq: str = "seq") -> DataFrame:
    """Stable by a small key: rows of one key keep their positions' order; ``seq`` is the place."""
    return ranked(df, [key, position], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), seq)


def first_per_group(df: DataFrame, group: list[str], keys: list[Column | str], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group; rows beyond are dropped before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*keys)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).drop("__rank")


def sorted_ranges(df: DataFrame, keys: list[Column | str], parts: int, *also: Column) -> DataFrame:
    """``df`` written in ``parts`` sorted ranges of its keys, one a task, with the range's number in
    ``__part``; ranges keep their rows and order when read again."""
    return cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("__part"), *also))


def ranked(df: DataFrame, keys: list[Column | str], parts: int, seq: str = "seq") -> DataFrame:
    """``df`` with its place in the whole order, from 1, without one task seeing all rows.

    Rows move once: sorted ranges are numbered where they are, and shifted by the sizes of those
    before, which the driver adds up, a number a range. Rows of equal keys get places in an
    order that the written ranges fix.
    """
    row_of = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of its task
    ranged = sorted_ranges(df, keys, parts, row_of.alias("__at"))
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offset = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long"))
    return ranged.join(offset, "__part").withColumn(seq, F.col("__before") + F.col("__at") + 1).drop("__part", "__before", "__at")
