"""Session helpers shared by every subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and all tasks run in this process (tests, a laptop) is a
    temporary folder set; on a cluster its absence raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return named or given.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillstone-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of files, as they lie, whose rows one task sorts or groups: half a million of the widest
#: tables' rows, so that a task's memory doesn't grow with the input.
TASK_BYTES = 8 << 20


def tasks_for(*frames: DataFrame) -> int:
    """How many tasks the rows of ``frames`` are dealt out to: the session's number of shuffle
    partitions, or more, in proportion to the files that are read for them."""
    size = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            # written frames don't know their size; all others do
            if "Relation" in leaf.getClass().getSimpleName():
                size += int(leaf.stats().sizeInBytes())
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def cut_dealt(df: DataFrame, key: str) -> DataFrame:
    """``cut`` of a ``df`` that was dealt out by ``key``, sorted by it in each task: later joins and groups on
    the key don't move it again. Adaptive plans don't tell how their rows are dealt, so this one isn't."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.sortWithinPartitions(key))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """Bind ``value`` once inside an expression: ``body`` gets a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
