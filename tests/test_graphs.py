import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import components, distances, ingest, mst, search
from quillstone.operators.graph import Graph, disjoint_sets, forest_edges, isolated_forest, sets

# Instances and results of Cormen, Leiserson, Rivest and Stein, "Introduction to
# Algorithms", chapters on graphs (BFS, DFS, DIJKSTRA, NEGATIVE, TREE, and the disjoint sets below).
BFS = [(0, 4), (1, 5), (0, 1), (2, 3), (2, 6), (3, 6), (3, 7), (5, 2), (5, 6), (6, 7)]
DFS = [(0, 1), (0, 3), (1, 4), (2, 4), (2, 5), (3, 1), (4, 3), (5, 5)]
DIJKSTRA = [(0, 1, 10), (0, 3, 5), (1, 2, 1), (1, 3, 2), (2, 4, 4), (3, 1, 3), (3, 2, 9), (3, 4, 2), (4, 0, 7), (4, 2, 6)]
NEGATIVE = [(0, 1, 3), (0, 2, 8), (0, 4, -4), (1, 3, 1), (1, 4, 7), (2, 1, 4), (3, 0, 2), (3, 2, -5), (4, 3, 6)]
TREE = [(0, 1, 4), (0, 7, 8), (1, 2, 8), (1, 7, 11), (2, 3, 7), (2, 5, 4), (2, 8, 2), (3, 4, 9), (3, 5, 14), (4, 5, 10), (5, 6, 2), (6, 7, 1), (6, 8, 6), (7, 8, 7)]
TOPO = [(4, 1), (4, 6), (1, 0), (1, 3), (6, 3), (3, 5), (0, 5), (2, 5)]


def graph(spark, n, edges, directed=True):
    schema = "src long, dst long" + (", w long" if edges and len(edges[0]) == 3 else "")
    return Graph.range(spark, n, spark.createDataFrame(edges, schema), directed)


def row(df, source=None):
    return [r.dist for r in df.orderBy("src", "dst").collect() if source is None or r.src == source]


def grouped(spark, n, edges):
    v = spark.range(n).select(F.lit(7).cast("long").alias("graph_id"), "id")
    e = spark.createDataFrame([(7, a, b, i) for i, (a, b) in enumerate(edges)], "graph_id long, src long, dst long, adj long")
    return v, e


def random_edges(n, m, seed, loops=True, weights=None):
    """Seeded directed edges with branches, cycles and, unless told otherwise, loops; in the order
    of adjacency."""
    rng, out = random.Random(seed), []
    while len(out) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if (loops or a != b) and (a, b) not in out:
            out.append((a, b))
    return [(*e, rng.randint(*weights)) for e in out] if weights else out


def test_degrees_and_statistics(spark):
    edges = random_edges(9, 20, 3, weights=(1, 9))
    g = graph(spark, 10, edges)
    count = lambda k, v: sum(e[k] == v for e in edges)
    assert [r.degree for r in g.degrees("out").orderBy("id").collect()] == [count(0, v) for v in range(10)]
    assert [r.degree for r in g.degrees("in").orderBy("id").collect()] == [count(1, v) for v in range(10)]
    once = {(min(a, b), max(a, b)): w for a, b, w in edges}
    u = graph(spark, 10, [(a, b, w) for (a, b), w in once.items()], False)
    assert [r.degree for r in u.degrees().orderBy("id").collect()] == [sum(v in e for e in once) for v in range(10)]
    assert u.arcs().count() == 2 * len(once) - sum(a == b for a, b in once) and u.num_edges() == len(once)
    s = g.statistics().first()
    assert (s.num_vertices, s.num_edges, s.deg_out_max, s.deg_in_min) == (10, 20, max(count(0, v) for v in range(10)), 0.0)
    assert {r.id for r in g.neighbors(4, "in").collect()} == {a for a, b, _ in edges if b == 4} and g.degree(3) == count(0, 3)


def test_forest_and_sets(spark):
    f = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (6, 5), (7, None), (8, 7), (0, None)], "v long, parent long")
    assert {tuple(sorted((r.src, r.dst))) for r in forest_edges(f).collect()} == {(0, 1), (0, 2), (1, 3), (1, 4), (0, 5), (5, 6), (7, 8)}
    assert isolated_forest(spark.range(3)).filter("parent is null").count() == 3
    pairs = spark.createDataFrame([(1, 3), (4, 6), (0, 2), (7, 8), (0, 1), (4, 5), (1, 2)], "u long, v long")
    assert [r.members for r in sets(disjoint_sets(pairs, spark.range(10))).collect()] == [[0, 1, 2, 3], [4, 5, 6], [7, 8], [9]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (300, 300), (None, 1)]
    got = {r.v: r.component for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[300] == 300 and len(got) == 64
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_searches(spark):
    assert {r.id: r.dist for r in search.reachable(graph(spark, 8, BFS, False), 1).collect()} == dict(enumerate([1, 0, 2, 3, 2, 1, 2, 3]))
    order = [r.u for r in search.bfs(*grouped(spark, 8, BFS + [(b, a) for a, b in BFS]), 1).filter("kind = 'discovered'").orderBy("seq").collect()]
    assert order == [1, 5, 0, 2, 6, 4, 3, 7]
    events = search.dfs(*grouped(spark, 6, DFS)).orderBy("seq").collect()
    assert [(r.u, int(r.v)) for r in events if r.kind == "back"] == [(3, 1), (5, 5)]
    forest = {r.v: r.parent for r in search.dfs_forest(*grouped(spark, 6, DFS)).collect()}
    assert forest == {0: None, 1: 0, 4: 1, 3: 4, 2: None, 5: 2}
    assert search.is_connected(graph(spark, 8, BFS, False)) and not search.is_connected(graph(spark, 9, BFS, False))
    assert search.is_connected(Graph.range(spark, 0, spark.createDataFrame([], "src long, dst long"), False))


def slow_dfs(near):
    """Events and finishing times by recursion."""
    out, state = [], {}

    def visit(u):
        state[u] = "open"
        out.append(("discovered", u, None))
        for v in near[u]:
            if v not in state:
                out.append(("tree", u, v))
                visit(v)
            elif state[v] == "open":
                out.append(("back", u, v))
        state[u] = "done"
        out.append(("finished", u, None))

    for root in sorted(near):
        if root not in state:
            visit(root)
    return out


def slow_bfs(near, source):
    out, dist, row = [("discovered", source, None)], {source: 0}, [source]
    for u in row:  # grows while it is read
        for v in near[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                row.append(v)
                out += [("tree", u, v), ("discovered", v, None)]
        out.append(("finished", u, None))
    return out, dist


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_searches_against_plain_ones(spark, seed):
    """Graphs with branches, back edges and cross edges."""
    n, edges = 40, random_edges(40, 90, seed)
    near = {v: [b for a, b in edges if a == v] for v in range(n)}
    read = lambda df: [(r.kind, r.u, r.v) for r in df.orderBy("seq").collect()]
    want = slow_dfs(near)
    assert read(search.dfs(*grouped(spark, n, edges))) == want
    assert {k for k, *_ in want} == {"discovered", "tree", "back", "finished"}
    forest = {r.v: r.parent for r in search.dfs_forest(*grouped(spark, n, edges)).collect()}
    assert {v: p for v, p in forest.items() if p is not None} == {v: u for k, u, v in want if k == "tree"}
    events, dist = slow_bfs(near, 3)
    assert read(search.bfs(*grouped(spark, n, edges), 3)) == events
    assert {r.id: r.dist for r in search.reachable(graph(spark, n, edges), 3).collect()} == dist
    down = [(a, b) for a, b in edges if a < b]  # without cycles, many paths
    near = {v: [b for a, b in down if a == v] for v in range(n)}
    finish = [u for k, u, _ in slow_dfs(near) if k == "finished"][::-1]
    assert [r.v for r in search.topological_order(*grouped(spark, n, down), "finish").orderBy("seq").collect()] == finish
    order = [r.v for r in search.topological_order(*grouped(spark, n, down)).orderBy("seq").collect()]
    assert sorted(order) == list(range(n)) and all(order.index(a) < order.index(b) for a, b in down)


def test_topological_orders(spark):
    order = [r.v for r in search.topological_order(*grouped(spark, 7, TOPO)).orderBy("seq").collect()]
    assert sorted(order) == list(range(7)) and all(order.index(a) < order.index(b) for a, b in TOPO)
    finish = [r.v for r in search.topological_order(*grouped(spark, 7, TOPO), "finish").orderBy("seq").collect()]
    assert all(finish.index(a) < finish.index(b) for a, b in TOPO)
    level = {r.id: r.level for r in search.topological_levels(graph(spark, 7, TOPO)).collect()}
    assert level == {4: 0, 2: 0, 1: 1, 6: 1, 0: 2, 3: 2, 5: 3}
    for method in (search.source_removal, search.finish_order):
        with pytest.raises(search.HasCycles):
            method({0: [1], 1: [2], 2: [0]})
    with pytest.raises(search.HasCycles):
        search.topological_levels(graph(spark, 7, [*TOPO, (5, 4)]))


def test_single_source(spark):
    assert row(distances.single_source(graph(spark, 8, BFS), 1)) == [None, 0, 2, 3, None, 1, 2, 3]
    assert row(distances.single_source(graph(spark, 5, DIJKSTRA), 0, True)) == [0, 8, 9, 5, 7]
    und = [(0, 1, 10), (0, 3, 5), (1, 2, 1), (1, 3, 2), (2, 4, 4), (3, 2, 9), (3, 4, 2), (4, 0, 7)]
    assert row(distances.single_source(graph(spark, 5, und, False), 0, True)) == [0, 7, 8, 5, 7]
    seq = distances.enumerate_single_source(graph(spark, 8, BFS), 1).orderBy("seq").collect()
    assert [r.dst for r in seq] == [1, 5, 2, 6, 3, 7, 0, 4] and seq[-1].phase == "rest"
    with pytest.raises(ValueError):
        distances.single_source(graph(spark, 5, NEGATIVE), 0, True)


def test_all_pairs(spark):
    want = [[0, 1, -3, 2, -4], [3, 0, -4, 1, -1], [7, 4, 0, 5, 3], [2, -1, -5, 0, -2], [8, 5, 1, 6, 0]]
    assert row(distances.floyd_warshall(graph(spark, 5, NEGATIVE))) == sum(want, [])
    positive = [(a, b, abs(w)) for a, b, w in NEGATIVE]
    want = [[0, 3, 8, 4, 4], [3, 0, 6, 1, 7], [7, 4, 0, 5, 11], [2, 5, 5, 0, 6], [8, 11, 11, 6, 0]]
    g = graph(spark, 5, positive)
    assert row(distances.all_pairs(g, True)) == row(distances.floyd_warshall(g)) == sum(want, [])
    with pytest.raises(ValueError):
        distances.floyd_warshall(graph(spark, 2, [(0, 1, -1), (1, 0, -1)]))
    pieces = [(2, 4), (4, 1), (1, 2), (0, 3)]
    u = graph(spark, 5, pieces, False)
    hops = {(r.src, r.dst): r.dist for r in distances.all_pairs(u).collect()}
    near = {v: [b for e in pieces for a, b in (e, e[::-1]) if a == v] for v in range(5)}
    assert hops == {(a, b): slow_bfs(near, a)[1].get(b) for a in range(5) for b in range(5)} and hops[0, 4] is None
    for is_weighted, h in ((False, u), (True, g)):
        every = {(r.src, r.dst): r.dist for r in distances.all_pairs(h, is_weighted).collect()}
        enum = distances.enumerate_all_pairs(h, is_weighted).collect()
        assert {(r.src, r.dst): r.dist for r in enum} == every and len(enum) == 25
        bare = distances.enumerate_no_self(h, is_weighted).collect()
        assert {(r.src, r.dst): r.dist for r in bare} == {k: v for k, v in every.items() if k[0] != k[1]} and len(bare) == 20
        by = [(r.seq, r.dist, r.src, r.dst) for r in distances.enumerate_sorted(h, is_weighted).orderBy("seq").collect()]
        want = sorted(every, key=lambda k: (every[k] is None, every[k] or 0, *k))
        assert by == [(i + 1, every[k], *k) for i, k in enumerate(want)]


def test_distances_in_blocks(spark, monkeypatch):
    """A matrix of several blocks, with negative weights and pieces that don't meet."""
    monkeypatch.setattr(distances, "SIDE", 4)
    n, up = 14, list(range(40, 54))
    edges = [(a, b, w - 3 * (a < b)) for a, b, w in random_edges(n - 2, 30, 5, loops=False, weights=(20, 60))]
    d = [[0 if a == b else None for b in range(n)] for a in range(n)]
    for a, b, w in edges:
        d[a][b] = w
    for k in range(n):
        for a in range(n):
            for b in range(n):
                if d[a][k] is not None and d[k][b] is not None and (d[a][b] is None or d[a][k] + d[k][b] < d[a][b]):
                    d[a][b] = d[a][k] + d[k][b]
    e = spark.createDataFrame([(up[a], up[b], w) for a, b, w in edges], "src long, dst long, w long")
    g = Graph(spark.createDataFrame([(x,) for x in up], "id long"), e)
    got = {(r.src, r.dst): r.dist for r in distances.floyd_warshall(g).collect()}
    assert got == {(up[a], up[b]): d[a][b] for a in range(n) for b in range(n)}
    with pytest.raises(ValueError):
        distances.floyd_warshall(graph(spark, 9, [(0, 5, 2), (5, 8, -4), (8, 0, 1)]))


def test_spanning_trees(spark):
    g = graph(spark, 9, TREE, False)
    t = mst.spanning_forest(g).collect()
    assert len(t) == 8 and sum(r.w for r in t) == 37
    assert [r.w for r in mst.kruskal_order(mst.spanning_forest(g)).orderBy("seq").collect()] == sorted(r.w for r in t)
    prim = mst.prim_order(mst.spanning_forest(g)).orderBy("seq").collect()
    seen = {0}
    for r in prim:
        assert r.parent in seen and r.v not in seen
        seen.add(r.v)
    assert len(seen) == 9
    enum = mst.enumerate_forest(g).collect()
    assert {(r.u, r.v, r.w) for r in enum} == {(r.u, r.v, r.w) for r in t} and {r.phase for r in enum} == {"credit", "search"}
    for solver in (mst.kruskal_by_parts, mst.prim_forest, lambda x: mst.spanning_forest(x)):
        assert {(r.u, r.v, r.w) for r in mst.enumerate_forest(g, solver).select("u", "v", "w").collect()} == {(r.u, r.v, r.w) for r in t}
    for whole in (mst.kruskal_by_parts(g), mst.prim_forest(g)):
        assert {(r.u, r.v, r.w) for r in whole.collect()} == {(r.u, r.v, r.w) for r in t}
    # edges that are chosen stay, however heavy; the rest is least beside them
    chosen = spark.createDataFrame([(3, 5, 14), (1, 7, 11)], "u long, v long, w long")
    for solver in (None, mst.kruskal_by_parts):
        more = mst.extension(g, chosen, solver).collect()
        flat = sorted((w - 100 * ((a, b) in ((3, 5), (1, 7))), a, b, w) for a, b, w in TREE)
        part, want = list(range(9)), set()
        for _, a, b, w in flat:
            if part[a] != part[b]:
                part = [part[a] if x == part[b] else x for x in part]
                want.add((a, b, w))
        assert {(r.u, r.v, r.w) for r in more} == want - {(3, 5, 14), (1, 7, 11)}
    hard = graph(spark, 6, [(0, 4, 135), (1, 2, 293), (2, 3, 70), (3, 5, 794), (4, 5, 71)], False)
    assert sorted(r.w for r in mst.enumerate_forest(hard).collect()) == [70, 71, 135, 293, 794]
    assert sorted(r.w for r in mst.spanning_forest(g, [-F.col("w")]).collect())[-3:] == [10, 11, 14]
    assert mst.spanning_forest(graph(spark, 3, TREE[:1], False)).count() == 1


def test_ingest(spark):
    nodes = spark.createDataFrame([(k,) for k in (900, 5, 70, 33)], "key long")
    edges = spark.createDataFrame([(5, 70, 2.9), (70, 5, 2.2), (5, 70, 4.0), (33, 900, 1.0)], "src long, dst long, length double")
    g, ids = ingest.build(nodes, edges, "key", "length")
    assert {r.key: r.id for r in ids.collect()} == {5: 0, 33: 1, 70: 2, 900: 3}
    assert {tuple(r) for r in g.edges.collect()} == {(0, 2, 2), (0, 2, 4), (1, 3, 1)}
    assert ingest.build(nodes, edges)[0].edges.count() == 2
    assert search.reduce_to_component(g, 0).vertices.count() == 2
    bad = spark.createDataFrame([(5, 71, 1.0)], "src long, dst long, length double")
    with pytest.raises(Exception, match="unknown node 71"):
        ingest.build(nodes, bad)[0].edges.collect()


def _exchanges(spark, monkeypatch, run):
    """Exchanges in the plan of each written step of ``run``."""
    cls, counts = type(spark.range(1)), []
    written = cls.checkpoint

    def checkpoint(self, *args, **kwargs):
        counts.append(self._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return written(self, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(cls, "checkpoint", checkpoint)
        run()
    return counts


def test_distances_leave_arcs_where_they_lie(spark, monkeypatch):
    """After the arcs are dealt out a round moves its pairs once."""
    g = graph(spark, 6, [(i, i + 1, 1 + i % 3) for i in range(5)], False)
    counts = _exchanges(spark, monkeypatch, lambda: distances.single_source(g, 0, True))
    assert len(counts) > 6 and max(counts) == 1


def test_nearest_pairs_are_relaxed_first(spark, monkeypatch):
    monkeypatch.setattr(distances, "FEW", 0, raising=False)
    n, edges = 12, random_edges(12, 40, 5, weights=(0, 9))
    best = {(v, v): 0 for v in range(n)}
    for _ in range(n):
        for s in range(n):
            for a, b, w in edges:
                if (s, a) in best:
                    best[s, b] = min(best.get((s, b), 1 << 40), best[s, a] + w)
    got = distances.all_pairs(graph(spark, n, edges), True).collect()
    assert {(r.src, r.dst): r.dist for r in got if r.dist is not None} == best and len(got) == n * n
