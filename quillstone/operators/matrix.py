"""Matrices in long form, arrays with unset places, and comparison of row multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matrix(spark, rows: int, columns: int, value: Column | None = None) -> DataFrame:
    """``(i, j, value)`` of all places, null unless a value is given."""
    ij = spark.range(rows * columns).select(F.floor(F.col("id") / max(columns, 1)).alias("i"), (F.col("id") % max(columns, 1)).alias("j"))
    return ij.withColumn("value", value if value is not None else F.lit(None).cast("long"))


def from_flat(df: DataFrame, columns: int, position: str = "pos", value: str = "value") -> DataFrame:
    """Row-major values to ``(i, j, value)``."""
    return df.select(F.floor(F.col(position) / columns).alias("i"), (F.col(position) % columns).alias("j"), F.col(value).alias("value"))


def at(m: DataFrame, i: int, j: int) -> DataFrame:
    return m.filter((F.col("i") == i) & (F.col("j") == j)).select("value")


def set_places(writes: DataFrame) -> DataFrame:
    """``(index, value)`` after writes ``(op_seq, index, value)``: the last one of each index counts."""
    return writes.groupBy("index").agg(F.max_by("value", "op_seq").alias("value"))


def get_or(state: DataFrame, index: DataFrame, default) -> DataFrame:
    """Values of ``index(index)``, the default where a place is unset or out of range."""
    return index.join(state, "index", "left").select("index", F.coalesce("value", F.lit(default)).alias("value"))


def replay(operations: DataFrame) -> DataFrame:
    """``(op_seq, index, value)`` of every read in a log ``(op_seq, op, index, value)``: what was last
    written there, null if nothing was."""
    w = Window.partitionBy("index").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == "write", F.col("value")), ignorenulls=True).over(w)
    return operations.withColumn("read", last).filter("op = 'read'").select("op_seq", "index", F.col("read").alias("value"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two DataFrames hold the same rows equally often."""
    b = b.select(*a.columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
