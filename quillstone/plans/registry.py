"""Queries over the driver's tables, one per operator, with their SQL.

Instances come from whole tables: orders are scheduling instances (lines are jobs), nations
that trade are a weighted graph, suppliers and customers that trade a bipartite one, and
each nation's best partner a sparse directed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import generate, geo
from quillstone.operators import aggregation, components, distances, ingest, matrix, mst, scheduling, search, sorting
from quillstone.operators.graph import Graph, forest_edges
from quillstone.runtime import table, tasks_for
from quillstone.streaming import emissions

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "sched_f2_johnson"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- instances ---------------------------------------------------------------------------


def order_jobs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    qty = F.col("l_quantity").cast("long")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(tasks_for(li), "l_orderkey")
    li = li.withColumn("job", F.row_number().over(w).cast("long"))
    return li.select(F.col("l_orderkey").alias("instance_id"), "job", qty.alias("p"), qty.alias("p1"), (F.col("l_partkey") % 37 + 1).alias("p2"), (F.col("l_suppkey") % 53).alias("r"))


JOBS = """jobs AS (SELECT l_orderkey AS instance_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS job, CAST(l_quantity AS BIGINT) AS p, CAST(l_quantity AS BIGINT) AS p1, l_partkey % 37 + 1 AS p2, l_suppkey % 53 AS r FROM lineitem)"""


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Customer nation to supplier nation: the number of lines as ``n``, a weight ``w`` that no two share."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    # lines are counted by customer and supplier nation before anything wider moves
    lines = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    own = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey")
    t = lines.join(own, lines.l_orderkey == own.o_orderkey).groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("n").alias("n"))
    return t.withColumn("w", F.expr("(1000000 div n) * 625 + src * 25 + dst"))


TRADE = """trade AS (SELECT src, dst, n, (1000000 // n) * 625 + src * 25 + dst AS w FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2))"""


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def trade_graph(spark: SparkSession, d: str, directed: bool = True) -> Graph:
    return Graph(nations(spark, d), trade(spark, d).select("src", "dst", "w"), directed)


def best_partners(spark: SparkSession, d: str) -> Graph:
    """Every nation's edge to its heaviest other trading partner: sparse, directed, in pieces."""
    t = trade(spark, d).filter("src <> dst")
    return Graph(nations(spark, d), t.groupBy("src").agg(F.min_by(F.struct("dst", "w"), F.struct("w", "dst")).alias("m")).select("src", "m.dst", "m.w"))


BEST = f"{TRADE}, best AS (SELECT src, arg_min(dst, w) AS dst, min(w) AS w FROM trade WHERE src <> dst GROUP BY src)"


def _by_order(li: DataFrame, o: DataFrame) -> DataFrame:
    """Lines with their orders, dealt out to as many tasks as the tables ask for."""
    n = tasks_for(li, o)
    return li.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def deals(spark: SparkSession, d: str) -> DataFrame:
    """``(src, dst, w)``: customers (even ids) and suppliers (odd ids) that trade, by least quantity."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ends = _by_order(li, o).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), "l_quantity")
    return ends.repartition(tasks_for(li, o), "src", "dst").groupBy("src", "dst").agg(F.min("l_quantity").cast("long").alias("w"))


def deals_graph(spark: SparkSession, d: str) -> Graph:
    ids = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id")).unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id")))
    return Graph(ids, deals(spark, d), directed=False)


DEALS = """deals AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
ids AS (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier),
arcs AS (SELECT src, dst, w FROM deals UNION ALL SELECT dst, src, w FROM deals)"""


def _rounds(arcs: str, starts: str, cost: str, rounds: int) -> str:
    """Relaxation in SQL: ``d(s, v, d)`` after enough rounds for the data."""
    return f"""r(k, s, v, d) AS (
  SELECT 0, id, id, CAST(0 AS BIGINT) FROM ({starts})
  UNION ALL
  SELECT k, s, v, min(d) FROM (
    SELECT k + 1 AS k, s, v, d FROM r WHERE k < {rounds}
    UNION ALL SELECT r.k + 1, r.s, e.dst, r.d + {cost} FROM r JOIN {arcs} e ON r.v = e.src WHERE r.k < {rounds}) GROUP BY k, s, v),
dist AS (SELECT s, v, d FROM r WHERE k = {rounds})"""


# --- graph algebra -----------------------------------------------------------------------


@query(f"""WITH {TRADE} SELECT (SELECT count(*) FROM nation) AS num_vertices, (SELECT count(*) FROM trade) AS num_edges,
  min(CAST(i AS DOUBLE)) AS deg_in_min, avg(i) AS deg_in_avg, max(CAST(i AS DOUBLE)) AS deg_in_max, min(CAST(o AS DOUBLE)) AS deg_out_min, avg(o) AS deg_out_avg, max(CAST(o AS DOUBLE)) AS deg_out_max
FROM (SELECT (SELECT count(*) FROM trade WHERE dst = n_nationkey) AS i, (SELECT count(*) FROM trade WHERE src = n_nationkey) AS o FROM nation)""")
def graph_statistics(spark, d):
    return trade_graph(spark, d).statistics()


@query(f"WITH {DEALS} SELECT id, CAST(count(src) AS BIGINT) AS degree FROM ids LEFT JOIN arcs ON id = src GROUP BY id")
def graph_degrees(spark, d):
    return deals_graph(spark, d).degrees()


@query(f"WITH {BEST} SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(count(src) AS BIGINT) AS degree FROM nation LEFT JOIN best ON n_nationkey = dst GROUP BY 1")
def graph_in_degrees(spark, d):
    return best_partners(spark, d).degrees("in")


@query(f"WITH {TRADE} SELECT dst AS id, w FROM trade WHERE src = 3")
def graph_adjacencies(spark, d):
    return trade_graph(spark, d).adjacencies(3)


@query(f"WITH {TRADE} SELECT src AS id FROM trade WHERE dst = 3")
def graph_in_neighbors(spark, d):
    return trade_graph(spark, d).neighbors(3, "in")


@query(f"WITH {TRADE} SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, w FROM trade WHERE src <> dst")
def graph_symmetrised(spark, d):
    return trade_graph(spark, d, directed=False).arcs()


@query(f"WITH {TRADE} SELECT dst AS src, src AS dst, w FROM trade")
def graph_transpose(spark, d):
    return trade_graph(spark, d).transpose().edges


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_regionkey + 1000 AS b FROM nation), two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, c) AS (SELECT DISTINCT a, a FROM two UNION SELECT two.b, r.c FROM r JOIN two ON r.v = two.a) SELECT CAST(v AS BIGINT) AS v, CAST(min(c) AS BIGINT) AS component FROM r GROUP BY v""")
def graph_components(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("u"), (F.col("n_regionkey") + 1000).cast("long").alias("v"))
    return components.connected_components(n).select("v", "component")


@query(f"WITH RECURSIVE {DEALS}, {_rounds('arcs', 'SELECT min(src) AS id FROM arcs', '0', 8)} SELECT v, s AS component FROM dist")
def graph_components_deals(spark, d):
    """Customers and suppliers that trade: one piece, with hubs."""
    return components.connected_components(deals(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"))).select("v", "component")


@query("""SELECT CAST(min(n_nationkey) AS BIGINT) AS component, list_sort(list(CAST(n_nationkey AS BIGINT))) AS members FROM nation GROUP BY n_regionkey""")
def graph_disjoint_sets(spark, d):
    from quillstone.operators.graph import disjoint_sets, sets

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    low = n.groupBy("n_regionkey").agg(F.min("id").alias("u"))
    pairs = n.join(low, "n_regionkey").select("u", F.col("id").alias("v"))
    return sets(disjoint_sets(pairs, n.select("id"))).select("component", "members")


@query("SELECT c_custkey AS src, c_custkey // 3 AS dst, CAST(c_nationkey AS BIGINT) AS w FROM customer WHERE c_custkey // 3 > 0")
def graph_forest_edges(spark, d):
    """Customers as a forest: of key k the parent is the one of key k // 3."""
    up = F.floor(F.col("c_custkey") / 3).cast("long")
    forest = table(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.when(up > 0, up).alias("parent"), F.col("c_nationkey").cast("long").alias("w"))
    return forest_edges(forest)


# --- ingestion ---------------------------------------------------------------------------


@query("SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part)")
def ingest_dense_ids(spark, d):
    return ingest.dense_ids(table(spark, d, "part"), "p_name")


@query("""WITH ids AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation)
SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, CAST(floor(abs(x.n_nationkey - y.n_nationkey) * 1.5) AS BIGINT) AS w
FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey JOIN ids a ON a.n_name = x.n_name JOIN ids b ON b.n_name = y.n_name""")
def ingest_weighted_build(spark, d):
    n = table(spark, d, "nation")
    x, y = n.select(F.col("n_name").alias("src"), F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("dst"), F.col("n_nationkey").alias("b"), "n_regionkey")
    e = x.join(y, "n_regionkey").filter("a <> b").select("src", "dst", (F.abs(F.col("a") - F.col("b")) * 1.5).alias("length"))
    return ingest.build(n.select(F.col("n_name").alias("key")), e, length="length")[0].edges


@query(f"""WITH RECURSIVE {BEST}, r(v) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM r JOIN best ON src = v) SELECT src, dst, w FROM best WHERE src IN (SELECT v FROM r) AND dst IN (SELECT v FROM r)""")
def ingest_reduce_to_component(spark, d):
    return search.reduce_to_component(best_partners(spark, d), 0).edges


# --- search ------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {DEALS}, {_rounds("arcs", "SELECT min(c_custkey) * 2 AS id FROM customer", "1", 6)} SELECT v AS id, d AS dist FROM dist""")
def search_reachable(spark, d):
    first = table(spark, d, "customer").agg(F.min("c_custkey")).first()[0]
    return search.reachable(deals_graph(spark, d), first * 2)


def _line_trees(spark, d):
    """An order's lines as a graph: line j leads to lines 2j and 2j + 1, then, if there are such, to the
    line before it (across) and to the one that leads to its own (back)."""
    j = order_jobs(spark, d).select(F.col("instance_id").alias("graph_id"), F.col("job").alias("id"))
    up = lambda c, adj: F.struct(c.cast("long").alias("src"), F.col("id").alias("dst"), adj.alias("adj"))
    own = lambda c, adj: F.struct(F.col("id").alias("src"), c.cast("long").alias("dst"), adj.alias("adj"))
    tree = F.when(F.col("id") > 1, up(F.floor(F.col("id") / 2), F.col("id")))
    across = F.when((F.col("id") > 1) & (F.col("id") % 2 == 1), own(F.col("id") - 1, F.col("id") + 500))
    back = F.when(F.col("id") > 3, own(F.floor(F.col("id") / 4), F.col("id") + 1000))
    arcs = lambda *x: j.select("graph_id", F.explode(F.filter(F.array(*x), lambda a: a.isNotNull())).alias("a")).select("graph_id", "a.*")
    return j, arcs(tree), arcs(tree, across, back)


# where a line is in the tree: ranks of the children on its path
_PLACES = f"""WITH RECURSIVE {JOBS}, h(j, path) AS (SELECT CAST(1 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT 2 * j + b, list_append(path, b + 1) FROM h, (SELECT unnest([0, 1]) AS b) WHERE 2 * j + b <= (SELECT max(job) FROM jobs)),
c AS (SELECT instance_id AS graph_id, job AS u, job // 2 AS up, path FROM jobs JOIN h ON job = j)"""


@query(f"WITH {JOBS} SELECT instance_id AS graph_id, job AS v, CASE WHEN job > 1 THEN job // 2 END AS parent FROM jobs")
def search_dfs_forest(spark, d):
    v, _, e = _line_trees(spark, d)
    return search.dfs_forest(v, e)


@query(f"{_PLACES} SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY list_transform(path, lambda x: -x)) - 1 AS seq, u AS v FROM c")
def search_topological_sources(spark, d):
    v, e, _ = _line_trees(spark, d)
    return search.topological_order(v, e)


@query(ORACLES["search_topological_sources"])
def search_topological_finish(spark, d):
    v, e, _ = _line_trees(spark, d)
    return search.topological_order(v, e, "finish")


@query(f"""{_PLACES}, x AS (SELECT graph_id, 'discovered' AS kind, u, CAST(NULL AS BIGINT) AS v, CASE WHEN u = 1 THEN [0] ELSE [up, 0, u, 1] END AS turn FROM c
  UNION ALL SELECT graph_id, 'tree', up, u, [up, 0, u, 0] FROM c WHERE u > 1 UNION ALL SELECT graph_id, 'finished', u, NULL, [u, 1] FROM c)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY turn) - 1 AS seq, kind, u, v FROM x""")
def search_bfs_events(spark, d):
    v, _, e = _line_trees(spark, d)
    return search.bfs(v, e)


@query(f"""{_PLACES}, x AS (SELECT graph_id, 'discovered' AS kind, u, CAST(NULL AS BIGINT) AS v, list_append(path, 0) AS turn FROM c
  UNION ALL SELECT graph_id, 'tree', up, u, list_append(path, -1) FROM c WHERE u > 1 UNION ALL SELECT graph_id, 'back', u, u // 4, list_append(path, 8) FROM c WHERE u > 3
  UNION ALL SELECT graph_id, 'finished', u, NULL, list_append(path, 9) FROM c)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY turn) - 1 AS seq, kind, u, v FROM x""")
def search_dfs_events(spark, d):
    v, _, e = _line_trees(spark, d)
    return search.dfs(v, e)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS level FROM nation""")
def search_topological_levels(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), "n_regionkey")
    e = n.select("src", F.lead("src").over(Window.partitionBy("n_regionkey").orderBy("src")).alias("dst")).filter("dst is not null")
    return search.topological_levels(Graph(n.select(F.col("src").alias("id")), e))


@query("SELECT (SELECT count(DISTINCT n_regionkey) FROM nation) <= 1 AS connected")
def search_is_connected(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 1000).cast("long").alias("dst"))
    return spark.range(1).select(F.lit(search.is_connected(Graph.from_edges(n, directed=False))).alias("connected"))


# --- distances ---------------------------------------------------------------------------

_NATION_IDS = "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation"
_PAIRS = f"SELECT a.id AS src, b.id AS dst, d AS dist FROM ({_NATION_IDS}) a CROSS JOIN ({_NATION_IDS}) b LEFT JOIN dist ON s = a.id AND v = b.id"
_HOPS = f"WITH RECURSIVE {BEST}, {_rounds('best', _NATION_IDS, '1', 25)}"
_WEIGHTS = f"WITH RECURSIVE {BEST}, {_rounds('best', _NATION_IDS, 'e.w', 25)}"
_DENSE = f"WITH RECURSIVE {TRADE}, {_rounds('trade', _NATION_IDS, 'e.w', 8)}"


@query(f"{_HOPS} {_PAIRS} WHERE a.id = 0")
def sssd_bfs(spark, d):
    return distances.single_source(best_partners(spark, d), 0)


@query(f"{_HOPS} SELECT CASE WHEN dist IS NULL THEN 'rest' ELSE 'search' END AS phase, row_number() OVER (ORDER BY dist NULLS LAST, dst) AS seq, src, dst, dist FROM ({_PAIRS} WHERE a.id = 0)")
def sssd_enum_bfs(spark, d):
    return distances.enumerate_single_source(best_partners(spark, d), 0)


@query(f"WITH RECURSIVE {DEALS}, {_rounds('arcs', 'SELECT min(c_custkey) * 2 AS id FROM customer', 'e.w', 12)} SELECT (SELECT min(c_custkey) * 2 FROM customer) AS src, id AS dst, d AS dist FROM ids LEFT JOIN dist ON v = id")
def sssd_dijkstra(spark, d):
    first = table(spark, d, "customer").agg(F.min("c_custkey")).first()[0]
    return distances.single_source(deals_graph(spark, d), first * 2, True)


@query(f"{_WEIGHTS} SELECT CASE WHEN dist IS NULL THEN 'rest' ELSE 'search' END AS phase, row_number() OVER (ORDER BY dist NULLS LAST, dst) AS seq, src, dst, dist FROM ({_PAIRS} WHERE a.id = 0)")
def sssd_enum_dijkstra(spark, d):
    return distances.enumerate_single_source(best_partners(spark, d), 0, True)


@query(f"{_HOPS} {_PAIRS}")
def apsd_bfs(spark, d):
    return distances.all_pairs(best_partners(spark, d))


@query(f"{_HOPS} SELECT CASE WHEN src = dst THEN 'credit' ELSE 'search' END AS phase, src, dst, dist FROM ({_PAIRS})")
def apsd_enum_bfs(spark, d):
    return distances.enumerate_all_pairs(best_partners(spark, d))


@query(f"{_HOPS} SELECT CASE WHEN dist = 1 OR src NOT IN (SELECT src FROM best) THEN 'credit' ELSE 'search' END AS phase, src, dst, dist FROM ({_PAIRS}) WHERE src <> dst")
def apsd_enum_bfs_no_self(spark, d):
    return distances.enumerate_no_self(best_partners(spark, d))


@query(f"{_HOPS} SELECT row_number() OVER (ORDER BY dist NULLS LAST, src, dst) AS seq, src, dst, dist FROM ({_PAIRS})")
def apsd_enum_bfs_sorted(spark, d):
    return distances.enumerate_sorted(best_partners(spark, d))


@query(f"{_DENSE} {_PAIRS}")
def apsd_dijkstra(spark, d):
    return distances.all_pairs(trade_graph(spark, d), True)


@query(f"{_DENSE} {_PAIRS}")
def apsd_floyd_warshall(spark, d):
    return distances.floyd_warshall(trade_graph(spark, d))


@query(f"{_DENSE} SELECT CASE WHEN src = dst THEN 'credit' ELSE 'search' END AS phase, src, dst, dist FROM ({_PAIRS})")
def apsd_enum_dijkstra(spark, d):
    return distances.enumerate_all_pairs(trade_graph(spark, d), True)


@query(f"{_WEIGHTS} SELECT CASE WHEN src NOT IN (SELECT src FROM best) OR EXISTS (SELECT 1 FROM best b WHERE b.src = p.src AND b.dst = p.dst) THEN 'credit' ELSE 'search' END AS phase, src, dst, dist FROM ({_PAIRS}) p WHERE src <> dst")
def apsd_enum_dijkstra_no_self(spark, d):
    return distances.enumerate_no_self(best_partners(spark, d), True)


@query(f"{_DENSE} SELECT row_number() OVER (ORDER BY dist NULLS LAST, src, dst) AS seq, src, dst, dist FROM ({_PAIRS})")
def apsd_enum_dijkstra_sorted(spark, d):
    return distances.enumerate_sorted(trade_graph(spark, d), True)


# --- spanning trees ----------------------------------------------------------------------

# an edge is in the forest exactly if no path of smaller keys joins its ends; the least largest
# key on a path comes from relaxation with max in the place of the sum
_TREE = f"""WITH RECURSIVE {TRADE}, und AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, w FROM trade WHERE src <> dst),
keyed AS (SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS key FROM und), arcs AS (SELECT u AS a, v AS b, key FROM keyed UNION ALL SELECT v, u, key FROM keyed),
r(k, s, x, key) AS (SELECT 0, CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT) FROM nation
  UNION ALL SELECT k, s, x, min(key) FROM (SELECT k + 1 AS k, s, x, key FROM r WHERE k < 24 UNION ALL SELECT r.k + 1, r.s, e.b, greatest(r.key, e.key) FROM r JOIN arcs e ON r.x = e.a WHERE r.k < 24) GROUP BY k, s, x),
tree AS (SELECT u, v, w FROM keyed JOIN r ON r.k = 24 AND r.s = u AND r.x = v AND r.key = keyed.key)"""


@query(f"{_TREE} SELECT u, v, w FROM tree")
def mst_boruvka(spark, d):
    return mst.spanning_forest(trade_graph(spark, d, directed=False)).select("u", "v", "w")


@query(f"{_TREE} SELECT row_number() OVER (ORDER BY w, u, v) AS seq, u, v, w FROM tree")
def mst_kruskal(spark, d):
    return mst.kruskal_order(mst.spanning_forest(trade_graph(spark, d, directed=False)))


@query(f"""{_TREE}, ways AS (SELECT u AS a, v AS b, w, u, v FROM tree UNION ALL SELECT v, u, w, u, v FROM tree),
p(seq, seen, v, parent, w) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL SELECT seq + 1, list_append(seen, e.b), e.b, e.a, e.w FROM (SELECT p.seq, p.seen, arg_min(struct_pack(a := ways.a, b := ways.b, w := ways.w), [ways.w, ways.u, ways.v]) AS e FROM p JOIN ways ON list_contains(p.seen, ways.a) AND NOT list_contains(p.seen, ways.b) GROUP BY p.seq, p.seen))
SELECT CAST(0 AS BIGINT) AS component, seq, v, parent, w FROM p WHERE seq > 0""")
def mst_prim(spark, d):
    return mst.prim_order(mst.spanning_forest(trade_graph(spark, d, directed=False)))


@query(f"{_TREE}, low AS (SELECT a, min(key) AS key FROM arcs GROUP BY a) SELECT CASE WHEN key IN (SELECT key FROM low) THEN 'credit' ELSE 'search' END AS phase, u, v, w FROM tree JOIN keyed USING (u, v, w)")
def mst_enumerate(spark, d):
    return mst.enumerate_forest(trade_graph(spark, d, directed=False))


@query(_TREE.replace("ORDER BY w, u, v", "ORDER BY w DESC, u, v") + " SELECT u, v, w FROM tree")
def mst_maximum(spark, d):
    return mst.spanning_forest(trade_graph(spark, d, directed=False), [-F.col("w")]).select("u", "v", "w")


# --- scheduling --------------------------------------------------------------------------

_F2 = f"""WITH {JOBS}, o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY p1 > p2, CASE WHEN p1 <= p2 THEN p1 ELSE -p2 END, job) AS k FROM jobs),
a AS (SELECT *, coalesce(sum(p1) OVER (PARTITION BY instance_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s1, coalesce(sum(p2) OVER (PARTITION BY instance_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM o),
b AS (SELECT *, c + max(s1 + p1 - c) OVER (PARTITION BY instance_id ORDER BY k) AS s2 FROM a),
parts AS (SELECT instance_id, job, 1 AS machine, CAST(s1 AS BIGINT) AS start FROM b UNION ALL SELECT instance_id, job, 2, CAST(s2 AS BIGINT) FROM b)"""


@query(f"{_F2} SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY start, machine, job) AS seq, job, machine, start FROM parts")
def sched_f2_johnson(spark, d):
    return scheduling.two_machine_flow_shop(order_jobs(spark, d))


@query(f"""WITH {JOBS}, a AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY instance_id ORDER BY r, job ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM jobs)
SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY r, job) AS seq, job, CAST(c + max(r - c) OVER (PARTITION BY instance_id ORDER BY r, job) AS BIGINT) AS start FROM a""")
def sched_release_times(spark, d):
    return scheduling.one_machine(order_jobs(spark, d))


@query("""WITH jobs AS (SELECT (((l_orderkey * 100003 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS job, CAST(l_quantity AS BIGINT) AS p, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) * 100 AS r FROM lineitem),
a AS (SELECT *, coalesce(sum(p) OVER (ORDER BY r, job ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM jobs) SELECT job, CAST(c + max(r - c) OVER (ORDER BY r, job) AS BIGINT) AS start FROM a""")
def sched_one_large_instance(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    jobs = table(spark, d, "lineitem").select(F.expr("(((l_orderkey * 100003 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber) * 64 + cast(l_quantity as long)").alias("job"), F.col("l_quantity").cast("long").alias("p"), (day * 100).alias("r"))
    return scheduling.one_machine_in_ranges(jobs, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("job", F.col("start").cast("long").alias("start"))


@query(f"""{_PLACES}, o AS (SELECT graph_id, u, row_number() OVER (PARTITION BY graph_id ORDER BY list_transform(path, lambda x: -x)) - 1 AS seq FROM c)
SELECT instance_id, seq, job, CAST(coalesce(sum(p) OVER (PARTITION BY instance_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM o JOIN jobs ON instance_id = graph_id AND job = u""")
def sched_precedences(spark, d):
    v, e, _ = _line_trees(spark, d)
    order = search.topological_order(v, e).select(F.col("graph_id").alias("instance_id"), "seq", F.col("v").alias("job"))
    return scheduling.in_order(order_jobs(spark, d).select("instance_id", "job", "p"), order)


_LPT = f"""WITH RECURSIVE {JOBS}, o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY p DESC, job) AS seq FROM jobs),
f(instance_id, seq, job, machine, start, a, b) AS (SELECT instance_id, seq, job, 0, CAST(0 AS BIGINT), p, CAST(0 AS BIGINT) FROM o WHERE seq = 1
  UNION ALL SELECT o.instance_id, o.seq, o.job, CASE WHEN a <= b THEN 0 ELSE 1 END, least(a, b), CASE WHEN a <= b THEN a + o.p ELSE a END, CASE WHEN a <= b THEN b ELSE b + o.p END FROM f JOIN o ON o.instance_id = f.instance_id AND o.seq = f.seq + 1)"""


def _two_machines(jobs):
    return jobs.select("instance_id").distinct().withColumn("machines", F.lit(2))


@query(f"{_LPT} SELECT instance_id, seq, job, machine, start FROM f")
def sched_lpt(spark, d):
    jobs = order_jobs(spark, d).select("instance_id", "job", "p")
    return scheduling.longest_first(jobs, _two_machines(jobs))


@query(_LPT.replace("o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY p DESC, job) AS seq FROM jobs)", """k AS (SELECT *, (job - 1) // 6 AS block, count(*) OVER (PARTITION BY instance_id) AS n FROM jobs),
x AS (SELECT *, (block + 1) * 6 <= n AND row_number() OVER (PARTITION BY instance_id, block ORDER BY p, job) = 1 AS credit FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY NOT credit, CASE WHEN credit THEN block END, CASE WHEN NOT credit THEN -p END, job) AS seq FROM x)""")
  + " SELECT f.instance_id, CASE WHEN credit THEN 'credit' ELSE 'search' END AS phase, f.seq, f.job, machine, start FROM f JOIN x ON x.instance_id = f.instance_id AND x.job = f.job")
def sched_lpt_enumerate(spark, d):
    jobs = order_jobs(spark, d).select("instance_id", "job", "p", F.col("job").alias("pos"))
    return scheduling.enumerate_longest_first(jobs, _two_machines(jobs))


@query(f"{_LPT} SELECT f.instance_id, CAST(max(start + p) AS BIGINT) AS makespan FROM f JOIN jobs USING (instance_id, job) GROUP BY f.instance_id")
def sched_makespan(spark, d):
    jobs = order_jobs(spark, d).select("instance_id", "job", "p")
    return scheduling.makespan(scheduling.longest_first(jobs, _two_machines(jobs)), jobs)


# --- ordering ----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 100")
def sort_smallest(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sorting.smallest(li, ["l_extendedprice", "l_orderkey", "l_linenumber"], 100)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def sort_largest(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sorting.smallest(li, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 100)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS seq FROM lineitem")
def sort_ranked(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = sorting.ranked(li, ["l_extendedprice", "l_orderkey", "l_linenumber"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select("l_orderkey", "l_linenumber", "seq")


@query("SELECT p_size, p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS seq FROM part")
def sort_counting(spark, d):
    return sorting.counting_sort(table(spark, d, "part").select("p_size", "p_partkey"), "p_size", "p_partkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) <= 3")
def sort_first_per_group(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return sorting.first_per_group(li, ["l_suppkey"], ["l_extendedprice", "l_orderkey", "l_linenumber"], 3)


# --- aggregation -------------------------------------------------------------------------


def measured(spark, d):
    """Lines as measurements: order status is the algorithm, line number the size, supplier the instance."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return _by_order(li, o).select(F.col("o_orderstatus").alias("algorithm"), F.col("l_returnflag").alias("parameters"), F.col("l_linenumber").alias("size"), F.col("l_suppkey").cast("string").alias("instance_seed"), F.col("l_quantity").cast("long").alias("total_time"), F.col("l_quantity").alias("quality"))


_MEASURED = "m AS (SELECT o_orderstatus AS algorithm, l_returnflag AS parameters, l_linenumber AS size, CAST(l_suppkey AS VARCHAR) AS instance_seed, CAST(l_quantity AS BIGINT) AS total_time, l_quantity AS quality FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("SELECT l_returnflag, count(l_quantity) AS l_quantity_n, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, avg(l_quantity) AS l_quantity_avg FROM lineitem GROUP BY 1")
def agg_streaming(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*aggregation.streaming("l_quantity"))


def _quartiles(v: str, source: str, group: str, name: str) -> str:
    part = lambda lo, n: f"(list_sort(list({v}))[{lo} + 1 + CAST(floor(({n} - 1) / 2) AS INT)] + list_sort(list({v}))[{lo} + 1 + CAST(floor({n} / 2) AS INT)]) / 2.0"
    half = f"(count({v}) // 2)"
    med = lambda lo, n: f"CASE WHEN {n} > 0 THEN {part(lo, n)} END"
    return f"SELECT {group}, count({v}) AS {name}_n, min({v}) AS {name}_min, max({v}) AS {name}_max, avg({v}) AS {name}_avg, {med('0', half)} AS {name}_q1, {med('0', f'count({v})')} AS {name}_median, {med(f'(count({v}) - {half})', half)} AS {name}_q3 FROM {source} GROUP BY {group}"


@query(_quartiles("l_quantity", "lineitem", "l_suppkey", "l_quantity"))
def agg_storing(spark, d):
    return aggregation.storing(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query(f"WITH {_MEASURED} SELECT algorithm, parameters, size, instance_seed, avg(total_time) AS total_time FROM m GROUP BY 1, 2, 3, 4")
def agg_per_instance(spark, d):
    return aggregation.per_instance(measured(spark, d), aggregation.TOTAL_FIELDS)


@query(f"WITH {_MEASURED}, i AS (SELECT algorithm, parameters, size, instance_seed, avg(total_time) AS t FROM m GROUP BY 1, 2, 3, 4) SELECT algorithm, parameters, size, count(*) AS total_time_n, min(t) AS total_time_min, max(t) AS total_time_max, avg(t) AS total_time_avg FROM i GROUP BY 1, 2, 3")
def agg_per_size(spark, d):
    return aggregation.per_size(measured(spark, d), aggregation.TOTAL_FIELDS)


@query(f"WITH {_MEASURED}, i AS (SELECT algorithm, parameters, size, instance_seed, avg(total_time) AS t FROM m GROUP BY 1, 2, 3, 4) " + _quartiles("t", "i", "algorithm, parameters, size", "total_time"))
def agg_per_size_quantiles(spark, d):
    return aggregation.per_size(measured(spark, d), aggregation.TOTAL_FIELDS, quantiles=True)


@query(f"WITH {_MEASURED}, f AS (SELECT parameters, size, instance_seed, avg(quality) AS ref FROM m WHERE algorithm = 'F' GROUP BY 1, 2, 3) SELECT algorithm, parameters, size, instance_seed, round(avg(quality / nullif(ref, 0)) + 1e-9, 6) AS ratio FROM m LEFT JOIN f USING (parameters, size, instance_seed) GROUP BY 1, 2, 3, 4")
def agg_ratio(spark, d):
    m = measured(spark, d)
    return aggregation.per_instance(aggregation.with_ratio(m, aggregation.reference_quality(m, "F")), []).select("algorithm", "parameters", "size", "instance_seed", F.round(F.col("ratio") + 1e-9, 6).alias("ratio"))


@query("SELECT p_partkey, 'alg' AS algorithm, 'n.sqrt(n)' AS parameters, CAST(p_size AS INTEGER) AS size, CAST(p_partkey AS VARCHAR) AS instance_seed FROM part")
def agg_parse_path(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("/x/"), F.col("p_size").cast("string"), F.lit("_n.sqrt(n)_"), F.col("p_partkey").cast("string"), F.lit(".alg.csv")).alias("path"))
    return p.select("p_partkey", *aggregation.parse_path(F.col("path")))


# --- arrays, scalars, measures -----------------------------------------------------------


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("op_seq"), F.when(F.col("event_type") == "view", "read").otherwise("write").alias("op"), F.col("user_id").alias("index"), F.col("value").alias("value"))


_LOG = "ops AS (SELECT event_id AS op_seq, CASE WHEN event_type = 'view' THEN 'read' ELSE 'write' END AS op, user_id AS index, value FROM events)"


@query(f"WITH {_LOG}, x AS (SELECT *, last_value(CASE WHEN op = 'write' THEN value END IGNORE NULLS) OVER (PARTITION BY index ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS got FROM ops) SELECT op_seq, index, got AS value FROM x WHERE op = 'read'")
def array_replay(spark, d):
    return matrix.replay(_log(spark, d))


@query(f"WITH {_LOG}, s AS (SELECT index, arg_max(value, op_seq) AS value FROM ops WHERE op = 'write' GROUP BY index) SELECT c_custkey AS index, coalesce(value, -1) AS value FROM customer LEFT JOIN s ON c_custkey = index")
def array_get_or(spark, d):
    state = matrix.set_places(_log(spark, d).filter("op = 'write'"))
    return matrix.get_or(state, table(spark, d, "customer").select(F.col("c_custkey").alias("index")), -1.0)


@query("SELECT CAST(p_partkey // 50 AS BIGINT) AS i, p_partkey % 50 AS j, p_size AS value FROM part")
def matrix_from_flat(spark, d):
    return matrix.from_flat(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").alias("value")), 50)


@query("""WITH p AS (SELECT s_suppkey AS id, radians(s_nationkey * 7.0 - 90) * 6378137.0 AS px, ln(tan(radians(s_nationkey * 3.0 - 40) / 2 + pi() / 4)) * 6378137.0 AS py FROM supplier),
b AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM p) SELECT id, round((px - x0) / greatest(x1 - x0, y1 - y0), 9) AS x, round((y1 - py) / greatest(x1 - x0, y1 - y0), 9) AS y FROM p, b""")
def geo_normalised(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 7.0 - 90).alias("lon"), (F.col("s_nationkey") * 3.0 - 40).alias("lat"))
    return geo.normalised(s).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("""WITH RECURSIVE g(k, x) AS (SELECT CAST(0 AS BIGINT), CAST(873654221 AS BIGINT) UNION ALL SELECT k + 1, x * 16807 % 2147483647 FROM g WHERE k < 100)
SELECT k, CAST(1 + floor(x / 2147483647.0 * 99) AS BIGINT) AS value FROM g WHERE k > 0""")
def generate_lcg(spark, d):
    return generate.lcg_draws(spark, 873654221, 100, 1, 99)


@query("SELECT CAST(60 AS BIGINT) AS num_vertices, true AS connected, true AS simple, true AS as_dense, true AS weights_in_range")
def generate_connected_graph(spark, d):
    """What every graph of these parameters has, whatever the seed draws."""
    g, p = generate.connected(spark, 60, 0.08, 1, weights=(1, 50)), 0.08
    pairs = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    mean, sd = p * 60 * 59 / 2, (60 * 59 / 2 * p * (1 - p)) ** 0.5
    return g.edges.agg(
        F.lit(g.num_vertices()).alias("num_vertices"), F.lit(search.is_connected(g)).alias("connected"),
        ((F.count_distinct(pairs) == F.count("*")) & (F.count_if(F.col("src") == F.col("dst")) == 0)).alias("simple"),
        (F.abs(F.count("*") - mean) < 5 * sd).alias("as_dense"), ((F.min("w") >= 1) & (F.max("w") <= 50)).alias("weights_in_range"),
    )


@query("SELECT CAST(200 AS BIGINT) AS num_vertices, CAST(200 AS BIGINT) AS in_order, true AS simple, true AS as_dense, true AS ids_permuted")
def generate_dag(spark, d):
    g, p = generate.dag(spark, 200, 0.05, 3), 0.05
    mean, sd = p * 200 * 199 / 2, (200 * 199 / 2 * p * (1 - p)) ** 0.5
    return g.edges.agg(
        F.lit(g.num_vertices()).alias("num_vertices"), F.lit(search.topological_levels(g).count()).alias("in_order"),
        ((F.count_distinct(F.struct("src", "dst")) == F.count("*")) & (F.count_if(F.col("src") == F.col("dst")) == 0)).alias("simple"),
        (F.abs(F.count("*") - mean) < 5 * sd).alias("as_dense"), ((F.count_if(F.col("src") > F.col("dst")) > 0) & (F.count_if(F.col("src") < F.col("dst")) > 0)).alias("ids_permuted"),
    )


@query("""WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id AS t FROM events),
y AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY seq) AS delay, min(t) FILTER (WHERE seq = 0) OVER (PARTITION BY user_id) AS t0 FROM x)
SELECT user_id, max(t) FILTER (WHERE seq = 0) AS preprocessing, max(t) FILTER (WHERE seq = 1) AS first_output, count(delay) AS delays, CAST(min(delay) AS DOUBLE) AS delay_min, CAST(max(delay) AS DOUBLE) AS delay_max, avg(delay) AS delay_avg, max((t - t0) / seq) FILTER (WHERE seq > 0) AS delay_inc_max FROM y GROUP BY user_id""")
def measure_emissions(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return emissions.measures(e.select("user_id", (F.row_number().over(w) - 1).alias("seq"), F.col("event_id").alias("t")), ["user_id"])


@query("""SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3""")
def stream_windowed(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = emissions.windowed(e, "ts", ["event_type"], "value", "1 day", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 6).alias("total"))
