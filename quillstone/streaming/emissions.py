"""Measures of an enumeration from the times at which it emitted parts, as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ["algorithm", "parameters", "size", "instance_seed", "run"]


def measures(emissions: DataFrame, run: list[str] | None = None) -> DataFrame:
    """One row a run from ``(run..., seq, t)`` with t in nanoseconds since the start; seq 0 is the end
    of preprocessing, parts count from 1."""
    run = run or RUN
    w = Window.partitionBy(*run).orderBy("seq")
    e = emissions.withColumn("delay", F.when(F.col("seq") > 0, F.col("t") - F.lag("t").over(w)))
    pre = F.max(F.when(F.col("seq") == 0, F.col("t")))
    part = F.when(F.col("seq") > 0, F.col("delay"))
    elapsed = F.when(F.col("seq") > 0, (F.col("t") - F.min(F.when(F.col("seq") == 0, F.col("t"))).over(w)) / F.col("seq"))
    return e.withColumn("inc", elapsed).groupBy(*run).agg(
        pre.alias("preprocessing"),
        F.max(F.when(F.col("seq") == 1, F.col("t"))).alias("first_output"),
        F.count(part).alias("delays"),
        F.min(part).cast("double").alias("delay_min"),
        F.max(part).cast("double").alias("delay_max"),
        F.avg(part).alias("delay_avg"),
        F.max("inc").alias("delay_inc_max"),
    )


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Counts and sums by key and window of event time; works on streams, where rows later than
    ``late`` are dropped and finished windows leave the state."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), *keys)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")
    )
