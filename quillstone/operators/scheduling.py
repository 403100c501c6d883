"""Machine schedules in closed form: window aggregates instead of loops over jobs.

``start_j = max(end_{j-1}, r_j)`` solves to ``start_j = C_j + max_{i<=j}(r_i - C_i)`` with
``C_j`` the processing time before j: a running sum and a running maximum. Instances are
groups of the window, so all are scheduled in one shuffle. A single instance of any size
can be scheduled in ranges by ``one_machine_in_ranges``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.sorting import sorted_ranges
from quillstone.runtime import cut, tasks_for


def _starts(order: Window, release: Column, p: Column) -> tuple[Column, Column]:
    """Columns of the processing time before a job, and of its start given those (as ``before``)."""
    before = F.coalesce(F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("before") + F.max(release - F.col("before")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return before, start


def one_machine(jobs: DataFrame) -> DataFrame:
    """``(instance_id, seq, job, start)`` of jobs ``(instance_id, job, p, r)``: by release, then job."""
    w = Window.partitionBy("instance_id").orderBy("r", "job")
    before, start = _starts(w, F.col("r"), F.col("p"))
    out = jobs.withColumn("before", before).withColumn("start", start)
    return out.select("instance_id", F.row_number().over(w).cast("long").alias("seq"), "job", F.col("start").cast("long").alias("start"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of a sorted range's jobs as if it began at time 0, and the time before each."""
    total, lead = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        p, r = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("p", "r"))
        before = total + np.cumsum(p) - p
        most = np.maximum.accumulate(r - before)
        most = most if lead is None else np.maximum(most, lead)
        total, lead = int(before[-1] + p[-1]), int(most[-1])
        cols = [b.column("job"), b.column("__part"), pa.array(p), pa.array(before), pa.array(before + most)]
        yield pa.RecordBatch.from_arrays(cols, ["job", "part", "p", "before", "start"])


def one_machine_in_ranges(jobs: DataFrame, parts: int) -> DataFrame:
    """``(job, start)`` of one instance too large for one task: ranges of release times.

    A range maps its entry time t to ``max(t + S, M)``; two numbers a range reach the driver,
    are composed there, and give each range its entry time. Jobs move once.
    """
    ranged = sorted_ranges(jobs.select(F.col("job").cast("long").alias("job"), F.col("p").cast("long").alias("p"), F.col("r").cast("long").alias("r")), ["r", "job"], parts)
    local = cut(ranged.mapInArrow(_scan, "job long, part int, p long, before long, start long"))
    sums = local.groupBy("part").agg(F.sum("p").alias("s"), F.max(F.col("start") + F.col("p")).alias("m")).orderBy("part").collect()
    entry, rows = 0, []
    for r in sums:
        rows.append((r.part, entry))
        entry = max(entry + r.s, r.m)
    entries = F.broadcast(jobs.sparkSession.createDataFrame(rows, "part int, entry long"))  # a row a range
    return local.join(entries, "part").select("job", F.greatest("start", F.col("entry") + F.col("before")).alias("start"))


def two_machine_flow_shop(jobs: DataFrame, second: str = "p2") -> DataFrame:
    """``(instance_id, seq, job, machine, start)`` of jobs ``(instance_id, job, p1, p2)``.

    Johnson's rule: jobs with p1 <= p2 by rising p1, then the others by falling p2; machines
    are 1 and 2, parts in order of time. ``second='p1'`` orders the second block by falling
    p1 instead, which isn't optimal.
    """
    late = F.col("p1") > F.col("p2")
    w = Window.partitionBy("instance_id").orderBy(late, F.when(~late, F.col("p1")), F.when(late, -F.col(second)), "job")
    first = jobs.withColumn("start1", F.coalesce(F.sum("p1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before, start = _starts(w, F.col("start1") + F.col("p1"), F.col("p2"))
    both = first.withColumn("before", before).withColumn("start2", start)
    parts = F.array(*[F.struct(F.lit(m).alias("machine"), F.col(f"start{m}").cast("long").alias("start")) for m in (1, 2)])
    out = both.select("instance_id", "job", F.explode(parts).alias("x")).select("instance_id", "job", "x.machine", "x.start")
    by = Window.partitionBy("instance_id").orderBy("start", "machine", "job")
    return out.select("instance_id", F.row_number().over(by).cast("long").alias("seq"), "job", "machine", "start")


def _met(schedule: DataFrame, jobs: DataFrame, how: str = "inner") -> DataFrame:
    """A schedule's rows with those of their jobs, dealt out by instance to as many tasks as the input asks for."""
    n, keys = tasks_for(schedule, jobs), ["instance_id", "job"]
    return schedule.repartition(n, *keys).join(jobs.repartition(n, *keys), keys, how).repartition(n, "instance_id")


def in_order(jobs: DataFrame, order: DataFrame) -> DataFrame:
    """``(instance_id, seq, job, start)``: jobs ``(instance_id, job, p)`` one after the other, in the
    topological ``order(instance_id, seq, job)``."""
    w = Window.partitionBy("instance_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return _met(order, jobs).select("instance_id", "seq", "job", F.coalesce(F.sum("p").over(w), F.lit(0)).cast("long").alias("start"))


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each job of a sorted stream to the least loaded machine (the first of equals) of its
    instance. A heap of machines is all that is kept from row to row."""
    held, heap, seq = None, [], 0
    for b in batches:
        out = []
        for i, machines, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if i != held:
                held, heap, seq = i, [(0, k) for k in range(machines)], 0
            load, k = heap[0]
            heapq.heapreplace(heap, (load + p, k))
            seq += 1
            out.append((seq, k, load))
        if out:
            done = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), *done], ["instance_id", "job", "phase", "seq", "machine", "start"])


def _assigned(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``(instance_id, job, phase, seq, machine, start)`` of ``rows(instance_id, machines, p, job,
    phase)`` in an order. Instances are streams of their own; one is sequential by nature and
    stays in one task, whose memory doesn't grow with it."""
    n = tasks_for(rows)
    dealt = rows.repartition(n, "instance_id").sortWithinPartitions("instance_id", *order)
    cols = [F.col("instance_id").cast("long").alias("instance_id"), F.col("machines").cast("int").alias("machines"), F.col("p").cast("long").alias("p"), F.col("job").cast("long").alias("job"), "phase"]
    return dealt.select(*cols).mapInArrow(_assign, "instance_id long, job long, phase string, seq long, machine int, start long")


def longest_first(jobs: DataFrame, machines: DataFrame) -> DataFrame:
    """``(instance_id, seq, job, machine, start)``: longest job first on the least loaded machine.

    ``jobs(instance_id, job, p)``, ``machines(instance_id, machines)``; machines count from 0.
    """
    rows = jobs.join(machines, "instance_id").withColumn("phase", F.lit("search"))
    return _assigned(rows, F.col("p").desc(), "job").select("instance_id", "seq", "job", "machine", "start")


def enumerate_longest_first(jobs: DataFrame, machines: DataFrame) -> DataFrame:
    """``(instance_id, phase, seq, job, machine, start)`` of jobs with their input order in ``pos``.

    Credit: of each whole block of 3 m jobs the first shortest one is placed, in order; then
    the others, longest first.
    """
    w = Window.partitionBy("instance_id").orderBy("pos")
    rows = jobs.join(machines, "instance_id").withColumn("k", F.row_number().over(w) - 1)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("instance_id")))
    size = 3 * F.col("machines")
    rows = rows.withColumn("block", F.floor(F.col("k") / size)).withColumn("whole", (F.col("block") + 1) * size <= F.col("n"))
    best = F.row_number().over(Window.partitionBy("instance_id", "block").orderBy("p", "k"))
    credit = F.col("whole") & (F.col("best") == 1)
    rows = rows.withColumn("best", best).withColumn("phase", F.when(credit, "credit").otherwise("search"))
    late = F.col("phase") == "search"
    done = _assigned(rows, late, F.when(~late, F.col("block")), F.when(late, -F.col("p")), "job")
    return done.select("instance_id", "phase", "seq", "job", "machine", "start")


def makespan(schedule: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(instance_id, makespan)``; a scheduled job that isn't one of the instance raises."""
    known = jobs.select("instance_id", "job", "p")
    end = F.when(F.col("p").isNull(), F.raise_error(F.lit("a job isn't known")).cast("long")).otherwise(F.col("start") + F.col("p"))
    return _met(schedule, known, "left").groupBy("instance_id").agg(F.max(end).cast("long").alias("makespan"))
