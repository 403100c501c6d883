import io
import itertools
import os
import random
import statistics
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.functions import generate, geo
from quillstone.operators import aggregation, matrix, scheduling, search, sorting
from quillstone.plans import cli, runner, sets
from quillstone.sources import files, osm
from quillstone.streaming import emissions


def test_sorting(spark):
    values = [(i * 37) % 101 for i in range(16)]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    assert [r.value for r in sorting.incremental(df, ["value"], first=4)] == sorted(values)
    assert [r.value for r in itertools.islice(sorting.incremental(df, ["value"], ascending=False), 3)] == sorted(values)[:-4:-1]
    assert "TakeOrderedAndProject" in sorting.smallest(df, ["value"], 3)._jdf.queryExecution().executedPlan().toString()
    # fixed values: the figure of counting sort in Cormen et al.
    keyed = spark.createDataFrame([(k, i) for i, k in enumerate((2, 5, 3, 0, 2, 3, 0, 3))], "k long, pos long")
    by = sorting.counting_sort(keyed, "k", "pos").orderBy("seq").collect()
    assert [(r.pos, r.k) for r in by] == [(3, 0), (6, 0), (0, 2), (4, 2), (2, 3), (5, 3), (7, 3), (1, 5)]
    assert [r.seq for r in sorting.ranked(df, ["value"], 3).orderBy("value").collect()] == list(range(1, 17))
    assert {(r.k, r.pos) for r in sorting.first_per_group(keyed, ["k"], ["pos"]).collect()} == {(0, 3), (2, 0), (3, 2), (5, 1)}


def test_orders_with_ties(spark):
    """Rows of equal keys all come, once each, in either way of reading an order."""
    rows = [(i % 7, i, None if i % 3 else "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, row long, n string").repartition(5)
    got = list(sorting.incremental(df, ["k"], first=64))
    assert [r.k for r in got] == sorted(r[0] for r in rows) and sorted((r.k, r.row, r.n) for r in got) == sorted(rows, key=lambda r: r[:2])
    falling = [r.k for r in sorting.incremental(df, ["k"], ascending=False, first=1)]
    assert falling == sorted((r[0] for r in rows), reverse=True)
    place = sorting.ranked(df, ["k"], 4).collect()
    assert sorted(r.seq for r in place) == list(range(1, 2001))
    assert [r.k for r in sorted(place, key=lambda r: r.seq)] == sorted(r[0] for r in rows)


def test_orders_move_rows_once(spark):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id AS row")
    for out in (sorting.ranked(df, ["k", "row"], 4), scheduling.one_machine_in_ranges(df.selectExpr("row AS job", "k AS p", "row AS r"), 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    single = aggregation.storing(df, ["k"], "row")
    assert "collect_list" not in single._jdf.queryExecution().toString()


# fixed values: samples with their quartiles from the encyclopedia's article on quartiles
@pytest.mark.parametrize(("values", "avg", "quartiles"), [([6, 7, 15, 36, 39, 40, 41, 42, 43, 47, 49], 33.18181, (15, 40, 43)), ([7, 15, 36, 39, 40, 41], 29.66666, (15, 37.5, 40)), ([5], 5, (None, 5, None))])
def test_quartiles(spark, values, avg, quartiles):
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "x double")
    r = aggregation.storing(df, [], "x").first()
    assert r.x_n == len(values) and r.x_avg == pytest.approx(avg, abs=1e-4) and (r.x_q1, r.x_median, r.x_q3) == quartiles


def test_quartiles_of_groups(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randint(0, 30))) for k in (None, "a", "b") for _ in range(rng.randint(30, 60))] + [("one", 3.0), ("none", None)]
    got = {r.g: r for r in aggregation.storing(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert set(got) == {None, "a", "b", "one", "none"}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        half = len(v) // 2
        q = [statistics.median(x) if x else None for x in (v[:half], v, v[len(v) - half :])]
        assert [r.x_q1, r.x_median, r.x_q3] == q and r.x_n == len(v)


def test_measurements(spark):
    rows = [("a", "p", 10, "1", 0, 10, 2.0), ("a", "p", 10, "1", 1, 30, 4.0), ("a", "p", 10, "2", 0, 100, 9.0), ("b", "p", 10, "1", 0, 5, 1.5)]
    runs = spark.createDataFrame(rows, runner.MEASUREMENT)
    table = {r.algorithm: r for r in aggregation.per_size(aggregation.with_ratio(runs, aggregation.reference_quality(runs, "b")), ["total_time"], True).collect()}
    assert (table["a"].total_time_n, table["a"].total_time_avg, table["a"].total_time_median) == (2, 60.0, 60.0)
    assert (table["a"].ratio_n, table["a"].ratio_avg, table["b"].ratio_avg) == (1, 2.0, 1.0)
    empty = runs.limit(0).agg(*aggregation.streaming("total_time")).first()
    assert empty.total_time_n == 0 and empty.total_time_avg is None


def test_file_names(spark):
    good = "/x/80_dense-loops_9914.some-way.csv"
    names = [good, "42_n.sqrt(n)_7.a.csv", "x_p_1.a.csv", "42_p.a.csv", "42_p_1.csv", "42_p_1_2.a.csv", "42_p_1.a.json"]
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "path string").select(*aggregation.parse_path(F.col("path"))).collect()]
    assert got[0] == ("some-way", "dense-loops", 80, "9914") and got[1] == ("a", "n.sqrt(n)", 42, "7")
    assert all(r[2] is None for r in got[2:])
    assert aggregation.file_name("a", "p", 3, "9") == "3_p_9.a.csv"


def test_arrays_and_matrices(spark):
    ops = spark.createDataFrame([(0, "write", 2, 21), (1, "read", 2, None), (2, "write", 2, 42), (3, "write", 0, 84), (4, "read", 2, None), (5, "read", 1, None)], "op_seq long, op string, index long, value long")
    assert [(r.op_seq, r.value) for r in matrix.replay(ops).orderBy("op_seq").collect()] == [(1, 21), (4, 42), (5, None)]
    state = matrix.set_places(ops.filter("op = 'write'"))
    assert [r.value for r in matrix.get_or(state, spark.range(4).withColumnRenamed("id", "index"), -1).orderBy("index").collect()] == [84, -1, 42, -1]
    m = matrix.matrix(spark, 2, 3, F.col("i") * 10 + F.col("j"))
    assert matrix.at(m, 1, 2).first().value == 12 and m.count() == 6
    assert matrix.same_rows(m, m.orderBy(F.desc("i"))) and not matrix.same_rows(m, m.union(m.limit(1)))


def test_generators(spark):
    # fixed values: first draws of the published benchmark generator (Taillard 1993), instance ta001
    first = [r.value for r in generate.lcg_draws(spark, 873654221, 6, 1, 99).orderBy("k").collect()]
    assert first == [54, 83, 15, 71, 77, 36] and generate.lcg_state(2**31 - 1) == 0xBAD
    shop = generate.flow_shop(spark, 20, 5, 873654221)
    assert [r.p for r in shop.filter("machine = 0").orderBy("job").limit(6).collect()] == first and shop.count() == 100
    assert generate.sorted_dag(spark, 50, 1.0, 1).count() == 50 * 49 // 2 and generate.sorted_dag(spark, 50, 0.0, 1).count() == 0
    n = generate.sorted_dag(spark, 400, 0.1, 5).distinct().count()
    assert abs(n - 0.1 * 400 * 399 / 2) < 500
    with pytest.raises(ValueError):
        generate.sorted_dag(spark, 5, 1.5, 1)
    assert sorted(r.to for r in generate.permutation(spark, 40, 3).collect()) == list(range(40))
    search.topological_levels(generate.dag(spark, 40, 0.1, 2))
    assert search.is_connected(generate.connected(spark, 20, 0.3, 4))
    g = generate.clique_and_path(spark, 4)
    assert g.num_vertices() == 20 and g.num_edges() == 5 + 16 + 1
    top = generate.release_times(spark, 30, 9, 0.5).agg(F.sum("p").alias("s"), F.max("r").alias("r")).first()
    assert 0 <= top.r <= top.s * 0.5
    log = generate.access_log(spark, 200, 10, 1)
    assert log.filter("(op = 'read') = (value is null)").count() == 200
    assert generate.elements(spark, 10, 1).count() == generate.parallel_machines(spark, 10, 2, 1).count() == 10


def test_projection(spark):
    df = spark.createDataFrame([(0, 8.0, 50.0), (1, 9.0, 50.5), (2, 8.5, 49.9)], "id long, lon double, lat double")
    back = df.select(geo.x_to_lon(geo.lon_to_x(F.col("lon"))).alias("lon"), geo.y_to_lat(geo.lat_to_y(F.col("lat"))).alias("lat")).collect()
    assert [(round(r.lon, 9), round(r.lat, 9)) for r in back] == [(8.0, 50.0), (9.0, 50.5), (8.5, 49.9)]
    box = geo.normalised(df, 100.0).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    assert box.a == box.c == 0 and max(box.b, box.d) == pytest.approx(100.0)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_csv(df, f"{tmp_path}/c", append=True)
    (tmp_path / "c" / "bad.csv").write_text("x,y\nnot a number,z\n3,c\n")
    assert sorted(r.x for r in files.read_csv(spark, f"{tmp_path}/c", "x long, y string").collect()) == [1, 1, 2, 2, 3]
    files.write_json(df, f"{tmp_path}/j")
    assert matrix.same_rows(files.read_json(spark, f"{tmp_path}/j", "x long, y string"), df)
    e = spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long")
    files.write_edge_list(e, f"{tmp_path}/e")
    assert matrix.same_rows(files.read_edge_list(spark, f"{tmp_path}/e"), e)
    made = []
    for _ in range(2):
        assert files.cached(spark, f"{tmp_path}/k", lambda: made.append(1) or df).count() == 2
    assert made == [1]
    (tmp_path / "d" / "deep").mkdir(parents=True)
    (tmp_path / "d" / "big.osm.pbf").write_bytes(b"x" * 50)
    (tmp_path / "d" / "deep" / "small.osm.pbf").write_bytes(b"x")
    found = files.listed(spark, f"{tmp_path}/d", ".osm.pbf")
    assert files.folders(found).count() == 2

    def read(path):
        if "big" in path:
            raise osm.TooLarge("too large")
        return df

    seen = []
    assert [p.rsplit("/", 1)[1] for p, _ in files.graphs(found, read, log=seen.append)] == ["small.osm.pbf"] and len(seen) == 1
    target = tmp_path / "got" / "f"
    open_ = lambda url: open(tmp_path / "d" / "big.osm.pbf", "rb")
    assert files.download("u", str(target), open_) == "downloaded" and files.download("u", str(target), open_) == "already exists"


def _v(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def _f(k, v):
    return _v(k << 3) + _v(v) if isinstance(v, int) else _v(k << 3 | 2) + _v(len(v)) + v


def test_road_source(spark, tmp_path, monkeypatch):
    zig = lambda xs: b"".join(_v(x << 1 if x >= 0 else ~(x << 1)) for x in xs)
    diff = lambda xs: [b - a for a, b in zip([0, *xs], xs)]
    ids, lat, lon = [10, 11, 12, 13], [500000000, 500010000, 500020000, 500030000], [80000000] * 4
    dense = _f(1, zig(diff(ids))) + _f(8, zig(diff(lat))) + _f(9, zig(diff(lon)))
    way = lambda k, refs, tag: _f(1, k) + _f(2, _v(1)) + _f(3, _v(tag)) + _f(8, zig(diff(refs)))
    strings = b"".join(_f(1, s) for s in (b"", b"highway", b"motorway", b"path"))
    data = b""
    # nodes and ways in blocks of their own, one of them compressed
    for i, group in enumerate((_f(2, dense), _f(3, way(1, [10, 11, 12], 2)) + _f(3, way(2, [12, 99, 13], 3)))):
        raw = _f(1, strings) + _f(2, group)
        blob = _f(3, zlib.compress(raw)) if i else _f(1, raw)
        head = _f(1, b"OSMData") + _f(3, len(blob))
        data += len(head).to_bytes(4, "big") + head + blob
    path = tmp_path / "r.osm.pbf"
    path.write_bytes(data)
    monkeypatch.setattr(osm, "STRETCH", 1)
    assert len(list(osm.stretches(str(path)))) == 2 and list(osm.stretches(path.as_uri())) == list(osm.stretches(str(path)))
    osm.register(spark)
    read = lambda **o: osm.roads(spark, str(path), **o)
    assert {(r.src, r.dst) for r in read()[1].collect()} == {(10, 12), (12, 13)}
    assert {(r.src, r.dst) for r in read(merge_ways=False)[1].collect()} == {(10, 11), (11, 12), (12, 13)}
    nodes, edges = read(require={"highway": ["motorway"]})
    only = edges.collect()
    assert [(r.src, r.dst) for r in only] == [(10, 12)] and only[0].length == pytest.approx(222.6, abs=0.3)
    assert {r.key for r in nodes.collect()} == {10, 12}
    with pytest.raises(osm.TooLarge, match="more than 1 edges"):
        read(max_size=1)
    cell = next(iter(sets.EXPERIMENTS["sssd_w_osm"].grid(spark, runner.Options(data=str(tmp_path)))))
    g = cell.make(spark, 1)
    assert g.num_vertices() == 3 and {r.w for r in g.edges.collect()} == {222, 111}


def test_emission_measures(spark, tmp_path):
    rows = [("r", 0, 100), ("r", 1, 130), ("r", 2, 190), ("r", 3, 200)]
    r = emissions.measures(spark.createDataFrame(rows, "run string, seq long, t long"), ["run"]).first()
    assert (r.preprocessing, r.first_output, r.delays, r.delay_min, r.delay_max) == (100, 130, 3, 10.0, 60.0)
    assert r.delay_inc_max == 45.0
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-02 05:00:00", "b", 4.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    q = emissions.windowed(stream, "ts", ["k"], "v", "1 hour", "10 minutes").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.k, r.n, r.total) for r in spark.table("w").collect()] == [("a", 2, 3.0)]


def test_runner(spark, tmp_path):
    options = runner.Options(runs=2, max_size=1000, log=lambda s: None)
    broken = runner.Algorithm("broken", lambda df: 1 / 0)
    total, pulled = runner.run_set(spark, [*sets.SETS["sorting"], broken], lambda n, seed: generate.elements(spark, n, seed), [50, 10**9], 1, options, f"{tmp_path}/m")
    assert total.count() == 2 and spark.read.parquet(f"{tmp_path}/m/total").count() == 2
    rows = pulled.collect()
    assert sorted(r.algorithm for r in rows) == ["enum-ihs"] * 2 + ["enum-iqs"] * 2
    assert all(r.delays == 50 and 0 < r.preprocessing < r.first_output and r.delay_min <= r.delay_avg <= r.delay_max for r in rows)


def test_delays_are_those_of_a_table_of_emissions(spark):
    rng = random.Random(9)
    t = list(itertools.accumulate(rng.randint(1, 99) for _ in range(30)))
    times = list(enumerate(t))
    want = emissions.measures(spark.createDataFrame([("r", *x) for x in times], "run string, seq long, t long"), ["run"]).drop("run").first()
    assert runner.delays(times) == pytest.approx(tuple(want))
    assert runner.delays([(0, 7)]) == (7, None, 0, None, None, None, None)
    ticks = iter(range(0, 100, 10))
    assert list(runner.emitted("ab", lambda: next(ticks))) == [(0, 10), (1, 20), (2, 30)]


def test_experiment_sets(spark, tmp_path):
    """All fifteen, each with its smallest place of the grid; instances are kept, statistics written,
    and measurements aggregated from the folder."""
    assert len(sets.EXPERIMENTS) == 15 and len(sets.SETS["mst"]) == 10
    cells = {}
    for name, x in sets.EXPERIMENTS.items():
        grid = list(itertools.islice(x.grid(spark, runner.Options()), 3))
        cells[name] = [(c.size, c.parameters) for c in grid]
    assert cells["p_cmax"] == [(10, "2"), (10, "3"), (10, "4")] and cells["sssd_u_osm"] == []
    assert cells["mst"] == [(100, "0.25"), (100, "0.125"), (100, "0.0625")] and cells["sort"][0] == (10, "default")
    options = runner.Options(runs=1, cache=f"{tmp_path}/c", statistics=[runner.graph_statistics], log=lambda s: pytest.fail(s))
    for _ in range(2):  # the second time from the kept instance
        runner.run_grid(spark, sets.SETS["p-cmax"][:1], itertools.islice(sets.EXPERIMENTS["p_cmax"].grid(spark, options), 1), 1, options, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p/total").count() == 2
    small = runner.Cell(12, "0.5", lambda spark, seed: generate.undirected(spark, 12, 0.5, seed, weights=(1, 9)))
    some = [a for a in sets.SETS["mst"] if a.name in ("total-prim", "incremental-kruskal")]
    runner.run_grid(spark, some, [small], 1, options, f"{tmp_path}/g")
    assert cli.main(["aggregate", f"{tmp_path}/g", "--offline"], spark) == 0
    table = spark.read.option("header", True).csv(f"{tmp_path}/g/enumeration-table")
    assert "delay_avg_q1" in table.columns and table.count() == 1
    folder = next(p for p in os.listdir(f"{tmp_path}/g/statistics"))
    assert spark.read.parquet(f"{tmp_path}/g/statistics/{folder}/0").first().num_vertices == 12
    with pytest.raises(SystemExit):
        cli.main(["run", "no-such-set", "x"], spark)


def test_links_are_fetched_in_turn(spark, tmp_path):
    (tmp_path / "links.csv").write_text("path,url\na/one.osm.pbf,http://x/1\nb.osm.pbf,http://x/bad\nc.osm.pbf,http://x/3\n")
    asked = []

    def opener(url):
        asked.append(url)
        if "bad" in url:
            raise OSError("no such file")
        return io.BytesIO(url.encode())

    get = lambda: files.fetch_links(spark, f"{tmp_path}/links.csv", f"{tmp_path}/f", opener, lambda s: None)
    assert get() == {"a/one.osm.pbf": "downloaded", "b.osm.pbf": "failed", "c.osm.pbf": "downloaded"}
    assert asked == ["http://x/1", "http://x/bad", "http://x/3"] and (tmp_path / "f/a/one.osm.pbf").read_bytes() == b"http://x/1"
    assert get()["a/one.osm.pbf"] == "already exists"


def test_sorting_enumerations_give_every_element(spark):
    values = [(i * 7919) % 3001 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    for a in sets.SETS["sorting"][1:]:
        got = [r.value for r in sorted(a.solve(df).collect(), key=lambda r: r.seq)]
        assert got == sorted(values, reverse=a.name == "enum-ihs")


def test_measured_tasks_follow_the_files(spark, tmp_path, monkeypatch):
    """Lines meet their orders in more tasks than the session says where the files are large."""
    from quillstone import runtime
    from quillstone.plans import registry

    li = spark.range(400).selectExpr("id div 4 AS l_orderkey", "id % 9 AS l_suppkey", "cast(id % 4 + 1 AS int) AS l_linenumber", "cast(id % 50 + 1 AS double) AS l_quantity", "'R' AS l_returnflag")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id AS o_orderkey", "id % 30 AS o_custkey", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(runtime, "TASK_BYTES", 1000, raising=False)
    for out, keys in ((registry.measured(spark, str(tmp_path)), ("l_orderkey", "o_orderkey")), (registry.deals(spark, str(tmp_path)), ("l_orderkey", "o_orderkey", "src"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        for key in keys:
            dealt = [int(line.split("), ")[0].rsplit(", ", 1)[1]) for line in plan.splitlines() if f"Exchange hashpartitioning({key}#" in line]
            assert dealt and min(dealt) > 4, (key, dealt)
