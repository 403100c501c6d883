"""Run experiments and aggregate what they measured: ``python -m quillstone.plans.cli --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from quillstone.operators import aggregation
from quillstone.plans import runner
from quillstone.plans.sets import EXPERIMENTS


def aggregate(spark: SparkSession, path: str, offline: bool = False, reference: str | None = None) -> dict[str, DataFrame]:
    """Output tables by folder from stored measurements: in one pass, or with quartiles
    (``offline``); with ratios to the quality of one algorithm."""
    out = {}
    for folder, fields in (("total", aggregation.TOTAL_FIELDS), ("enumeration", aggregation.ENUM_FIELDS)):
        try:
            runs = spark.read.parquet(f"{path}/{folder}")
        except AnalysisException:
            continue
        if reference:
            runs = aggregation.with_ratio(runs, aggregation.reference_quality(runs, reference))
        out[folder] = aggregation.per_size(runs, fields, quantiles=offline)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstone")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run an experiment set")
    run.add_argument("set", choices=sorted(EXPERIMENTS))
    run.add_argument("path", help="folder for measurements")
    run.add_argument("--max-size", type=int)
    run.add_argument("--runs", type=int)
    run.add_argument("--instances", type=int)
    run.add_argument("--seed", type=int, default=42)
    run.add_argument("--cache", help="folder that instances are kept in")
    run.add_argument("--data", help="folder of road graphs")
    run.add_argument("--statistics", action="store_true", help="write statistics of graphs")
    total = sub.add_parser("aggregate", help="aggregate measurements")
    total.add_argument("path")
    total.add_argument("--offline", action="store_true", help="with quartiles")
    total.add_argument("--reference", help="algorithm whose quality others are compared with")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "run":
        options = runner.Options(seed=a.seed, max_size=a.max_size, cache=a.cache, data=a.data, statistics=[runner.graph_statistics] if a.statistics else [])
        options.runs = a.runs or EXPERIMENTS[a.set].runs
        runner.run_experiment(spark, EXPERIMENTS[a.set], options, a.path, a.instances)
    else:
        for folder, table in aggregate(spark, a.path, a.offline, a.reference).items():
            table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.path}/{folder}-table")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
