import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone import runtime
from quillstone.operators import scheduling, search
from quillstone.plans import registry
from tests.test_graphs import TOPO, grouped

SCHEMA = "instance_id long, job long, p long"


def test_flow_shop(spark):
    # fixed values: an instance with its optimal order as published by Johnson (1954)
    jobs = spark.createDataFrame([(1, 1, 4, 5), (1, 2, 4, 1), (1, 3, 30, 4), (1, 4, 6, 30), (1, 5, 2, 3)], "instance_id long, job long, p1 long, p2 long")
    got = [(r.job, r.machine, r.start) for r in scheduling.two_machine_flow_shop(jobs).orderBy("seq").collect()]
    assert got == [(5, 1, 0), (1, 1, 2), (5, 2, 2), (4, 1, 6), (1, 2, 6), (3, 1, 12), (4, 2, 12), (2, 1, 42), (3, 2, 42), (2, 2, 46)]
    two = spark.createDataFrame([(1, 1, 10, 1), (1, 2, 9, 8)], "instance_id long, job long, p1 long, p2 long")
    end = lambda s: max(r.start + {1: 1, 2: 8}[r.job] for r in s.collect() if r.machine == 2)
    assert end(scheduling.two_machine_flow_shop(two)) == 20 and end(scheduling.two_machine_flow_shop(two, "p1")) == 27


def test_release_times(spark):
    rng = random.Random(6)
    rows = [(1, j, rng.randint(1, 60), rng.randint(0, 900)) for j in range(40)]
    jobs = spark.createDataFrame(rows, SCHEMA + ", r long")
    now, want = 0, []
    for r, j, p in sorted((r, j, p) for _, j, p, r in rows):
        now = max(now, r)
        want.append((j, now))
        now += p
    assert [(r.job, r.start) for r in scheduling.one_machine(jobs).orderBy("seq").collect()] == want
    assert sorted((r.job, r.start) for r in scheduling.one_machine_in_ranges(jobs, 3).collect()) == sorted(want)


def test_precedences(spark):
    p = [12, 7, 31, 4, 9, 22, 5]
    jobs = spark.createDataFrame([(7, j, x) for j, x in enumerate(p)], SCHEMA)
    order = search.topological_order(*grouped(spark, 7, TOPO)).selectExpr("graph_id as instance_id", "seq", "v as job")
    row = [r.job for r in order.orderBy("seq").collect()]
    want = [(j, sum(p[k] for k in row[:i])) for i, j in enumerate(row)]
    assert [(r.job, r.start) for r in scheduling.in_order(jobs, order).orderBy("seq").collect()] == want


def test_longest_first(spark):
    jobs = spark.createDataFrame([(1, j, p) for j, p in zip(range(1, 8), (5, 5, 4, 4, 3, 3, 3))], SCHEMA)
    machines = spark.createDataFrame([(1, 3)], "instance_id long, machines int")
    plan = scheduling.longest_first(jobs, machines)
    assert [(r.job, r.machine, r.start) for r in plan.orderBy("seq").collect()] == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 2, 4), (5, 0, 5), (6, 1, 5), (7, 0, 8)]
    assert scheduling.makespan(plan, jobs).first().makespan == 11
    with pytest.raises(Exception, match="a job isn't known"):
        scheduling.makespan(plan, jobs.filter("job > 1")).collect()


def test_longest_first_with_credit(spark):
    rng = random.Random(2)
    p = [rng.randint(1, 40) for _ in range(37)]
    jobs = spark.createDataFrame([(1, j, x, j) for j, x in enumerate(p)], SCHEMA + ", pos long")
    machines = spark.createDataFrame([(1, 3)], "instance_id long, machines int")
    loads, want, credit = [0, 0, 0], [], []
    for b in range(len(p) // 9):
        credit.append(min(range(9 * b, 9 * b + 9), key=lambda j: (p[j], j)))
    for phase, js in (("credit", credit), ("search", sorted(set(range(37)) - set(credit), key=lambda j: (-p[j], j)))):
        for j in js:
            m = loads.index(min(loads))
            want.append((phase, j, m, loads[m]))
            loads[m] += p[j]
    got = scheduling.enumerate_longest_first(jobs, machines).orderBy("seq").collect()
    assert [(r.phase, r.job, r.machine, r.start) for r in got] == want


def test_one_large_instance(spark):
    """An instance is a stream: time grows with its jobs, and instances don't meet."""
    import heapq
    import time

    n, m = 100_000, 50
    jobs = spark.range(n).selectExpr("id % 2 AS instance_id", "id AS job", "(id * 7919) % 97 + 1 AS p").cache()
    jobs.count()
    machines = spark.createDataFrame([(0, m), (1, m)], "instance_id long, machines int")
    began = time.time()
    got = scheduling.longest_first(jobs, machines).orderBy("instance_id", "seq").collect()
    assert time.time() - began < 20
    for i in (0, 1):
        heap = [(0, k) for k in range(m)]
        want = []
        for p, j in sorted((-((j * 7919) % 97 + 1), j) for j in range(i, n, 2)):
            load, k = heapq.heappop(heap)
            want.append((j, k, load))
            heapq.heappush(heap, (load - p, k))
        assert [(r.job, r.machine, r.start) for r in got if r.instance_id == i] == want


def test_tasks_follow_the_files(spark, tmp_path, monkeypatch):
    """Steps over lines are dealt out to more tasks than the session says where the files are large."""
    li = spark.range(400).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") * 7 % 50).alias("l_partkey"), (F.col("id") * 5 % 9).alias("l_suppkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).select(F.col("id").alias("o_orderkey"), (F.col("id") % 30).alias("o_custkey"), F.lit("F").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(runtime, "TASK_BYTES", 1000, raising=False)
    for name in ("sched_f2_johnson", "sched_precedences", "sched_lpt_enumerate", "sched_makespan", "search_bfs_events", "search_dfs_events", "search_dfs_forest", "search_topological_sources", "search_topological_finish"):
        out = registry.QUERIES[name](spark, str(tmp_path))
        dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())]
        assert dealt and min(dealt) > 4, (name, dealt)
