"""Aggregates of measurements: one pass, quartiles by halves, and means of instance means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.sorting import ranked
from quillstone.runtime import cut

INSTANCE = ["algorithm", "parameters", "size", "instance_seed"]
TOTAL_FIELDS = ["total_time"]
ENUM_FIELDS = ["preprocessing", "first_output", "delays", "delay_min", "delay_max", "delay_avg", "delay_inc_max"]
#: Name under which a reference quality is kept.
REFERENCE = "reference-quality"


def streaming(field: str, name: str | None = None) -> list[Column]:
    """Count, least, largest and mean in one pass with partial sums; all but the count are null when empty."""
    n, c = name or field, F.col(field).cast("double")
    return [F.count(c).alias(f"{n}_n"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.avg(c).alias(f"{n}_avg")]


def storing(df: DataFrame, group: list[str], field: str, name: str | None = None) -> DataFrame:
    """``streaming`` a group, and quartiles: medians of the lower and the upper half, the middle
    value in neither when the count is odd. NaN and null are left out.

    Values are ranked over all groups in sorted ranges, so a group of any size is spread over
    tasks; at most six rows a group, those that a median is the mean of, are added up.
    """
    if not group:
        return storing(df.withColumn("__all", F.lit(0)), ["__all"], field, name).drop("__all")
    n = name or field
    c = F.col(field).cast("double")
    rows = df.select(*group, F.when(~F.isnan(c), c).alias("__x"))
    whole = rows.groupBy(*group).agg(F.count("__x").alias(f"{n}_n"), F.min("__x").alias(f"{n}_min"), F.max("__x").alias(f"{n}_max"), F.avg("__x").alias(f"{n}_avg"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(ranked(rows.filter("__x is not null"), [*group, "__x"], parts, "__seq"))
    sizes = placed.groupBy(*group).agg(F.min("__seq").alias("__first"), F.count("*").alias("__n"))
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    at = placed.alias("p").join(sizes.alias("s"), same).select(*[f"p.{g}" for g in group], "__x", "__n", (F.col("__seq") - F.col("__first")).alias("__at"))
    half = F.floor(F.col("__n") / 2)

    def median(start: Column, size: Column) -> Column:
        low, high = start + F.floor((size - 1) / 2), start + F.floor(size / 2)
        here = F.when(F.col("__at") == low, F.col("__x")), F.when(F.col("__at") == high, F.col("__x"))
        return F.when(F.max(size) > 0, (F.max(here[0]) + F.max(here[1])) / 2)

    halves = {"q1": (F.lit(0), half), "median": (F.lit(0), F.col("__n")), "q3": (F.col("__n") - half, half)}
    quarters = at.groupBy(*group).agg(*[median(*x).alias(f"{n}_{k}") for k, x in halves.items()])
    same = [F.col(f"w.{g}").eqNullSafe(F.col(f"q.{g}")) for g in group]
    joined = whole.alias("w").join(quarters.alias("q"), same, "left")
    return joined.select(*[f"w.{g}" for g in group], *[f"w.{n}_{k}" for k in ("n", "min", "max", "avg")], *[f"q.{n}_{k}" for k in halves])


def reference_quality(runs: DataFrame, algorithm: str) -> DataFrame:
    """``(parameters, size, instance_seed, reference)``: mean quality of one algorithm an instance."""
    own = runs.filter(F.col("algorithm") == algorithm)
    return own.groupBy("parameters", "size", "instance_seed").agg(F.avg("quality").alias("reference"))


def with_ratio(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """``ratio``: quality over the instance's reference; null where there is none."""
    joined = runs.join(reference, ["parameters", "size", "instance_seed"], "left")
    return joined.withColumn("ratio", F.col("quality") / F.nullif(F.col("reference"), F.lit(0.0)))


def per_instance(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Means over the runs of each instance."""
    fields = [*fields, *(["ratio"] if "ratio" in runs.columns else [])]
    return runs.groupBy(*INSTANCE).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in fields])


def per_size(runs: DataFrame, fields: list[str], quantiles: bool = False) -> DataFrame:
    """The output table: aggregates of instance means by algorithm, parameters and size.

    Every instance weighs the same, however many runs it had.
    """
    means = per_instance(runs, fields)
    fields = [*fields, *(["ratio"] if "ratio" in runs.columns else [])]
    by = ["algorithm", "parameters", "size"]
    if not quantiles:
        return means.groupBy(*by).agg(*[c for f in fields for c in streaming(f)]).orderBy(*by)
    means, out = cut(means), None
    for f in fields:
        one = storing(means, by, f)
        out = one if out is None else out.join(one, by)
    return out.orderBy(*by)


# Fixed format of measurement files: size_parameters_seed.algorithm.csv; parameters may have dots.
FILE_NAME = r"(?:^|/)(\d+)_([^_/]+)_([^_/]+?)\.([^./]+)\.csv$"


def parse_path(path: Column) -> list[Column]:
    """Size, parameters, seed and algorithm of a measurement file; null where the name is another."""
    part = lambda i: F.nullif(F.regexp_extract(path, FILE_NAME, i), F.lit(""))
    return [part(4).alias("algorithm"), part(2).alias("parameters"), part(1).try_cast("int").alias("size"), part(3).alias("instance_seed")]


def file_name(algorithm: str, parameters: str, size: int, seed: str) -> str:
    return f"{size}_{parameters}_{seed}.{algorithm}.csv"
