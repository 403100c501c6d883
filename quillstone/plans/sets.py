"""The registered experiment sets: algorithms, grids of sizes and densities, and instances.

Sizes, densities and their labels are fixed values: they are what measurements are compared by.
An algorithm that only differs from another by the way one machine sorts or walks in memory has
the same plan here, and so the same function; it is listed once for each name that is measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import generate
from quillstone.operators import distances, ingest, matrix, mst, scheduling, search, sorting
from quillstone.operators.graph import Graph
from quillstone.plans.runner import Algorithm, Cell, ExperimentSet, Options, road_files
from quillstone.sources import osm


def _steps(low: int, high: int) -> list[int]:
    """1, 2, ... 9 times every power of ten from ``low``, as far as ``high``."""
    out, unit = [], low
    while unit <= high:
        out += [k * unit for k in range(1, 10) if k * unit <= high]
        unit *= 10
    return out


#: Densities of random graphs: constants of n * n, and powers of n.
CONSTANT = ("0.25", "0.125", "0.0625", "0.03125")
POWERS = {"n.sqrt(n)": 0.5, "n.sqrt(sqrt(n))": 0.25}
MOST_EDGES = 2**32 - 1


def densities(n: int, most: float) -> Iterator[tuple[float, str]]:
    """Edge probabilities with at least a vertex's worth of edges and at most ``most``."""
    every = [(float(c), c) for c in CONSTANT] + [(n**k / n, label) for label, k in POWERS.items()]
    return ((p, label) for p, label in every if n <= n * n * p <= most)


def _in_order(df: DataFrame, key) -> DataFrame:
    """Every row, with its place in the order."""
    return sorting.ranked(df, [key], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).orderBy("seq")


def _sizes(sizes: list[int], make: Callable) -> Callable:
    def grid(spark, options: Options) -> Iterator[Cell]:
        return (Cell(n, "default", lambda spark, seed, n=n: make(spark, n, seed)) for n in sizes if options.max_size is None or n <= options.max_size)

    return grid


def _graphs(sizes: list[int], most: float, make: Callable) -> Callable:
    def grid(spark, options: Options) -> Iterator[Cell]:
        for n in sizes:
            if options.max_size is None or n <= options.max_size:
                for p, label in densities(n, most):
                    yield Cell(n, label, lambda spark, seed, n=n, p=p: make(spark, n, p, seed))

    return grid


def _worst(ks: list[int]) -> Callable:
    """Near-clique and path; best and worst case of a search from one end."""
    return lambda spark, options: (Cell(k * k + k, "worst-case", lambda spark, seed, k=k: generate.clique_and_path(spark, k)) for k in ks if options.max_size is None or k * k + k <= options.max_size)


def _both(*grids: Callable) -> Callable:
    return lambda spark, options: chain.from_iterable(g(spark, options) for g in grids)


def _roads(is_weighted: bool, **only: list[str]) -> Callable:
    """A cell for each road file; its size is the file's in bytes."""

    def read(spark, path: str) -> Graph:
        nodes, edges = osm.roads(spark, path, require=only)
        return ingest.build(nodes.select("key"), edges, "key", "length" if is_weighted else None)[0]

    def grid(spark, options: Options) -> Iterator[Cell]:
        return (Cell(size, path.rsplit("/", 1)[-1].split(".")[0].replace("_", "-"), lambda spark, seed, path=path: read(spark, path)) for path, size in road_files(spark, options))

    return grid


def _one(df: DataFrame, **columns) -> DataFrame:
    return df.select(F.lit(1).cast("long").alias("instance_id"), *[c.alias(k) for k, c in columns.items()])


def _flow_shop(spark, n: int, seed: int) -> DataFrame:
    p = generate.flow_shop(spark, n, 2, seed % (2**31 - 2) + 1)
    return _one(p.groupBy("job").pivot("machine", [0, 1]).agg(F.first("p")), job=F.col("job"), p1=F.col("0"), p2=F.col("1"))


def _releases(spark, n: int, seed: int) -> DataFrame:
    return _one(generate.release_times(spark, n, seed % (2**31 - 2) + 1, 0.5), job=F.col("job"), p=F.col("p"), r=F.col("r"))


def _machines(spark, options: Options) -> Iterator[Cell]:
    """Every number of jobs with every smaller number of machines."""

    def make(spark, n: int, m: int, seed: int):
        jobs = generate.parallel_machines(spark, n, m, seed)
        return _one(jobs, job=F.col("job"), p=F.col("p"), pos=F.col("job")), _one(spark.range(1), machines=F.lit(m))

    for n in _steps(10, 9 * 10**8):
        if options.max_size is None or n <= options.max_size:
            for m in _steps(1, 9_000):
                if 1 < m < n:
                    yield Cell(n, str(m), lambda spark, seed, n=n, m=m: make(spark, n, m, seed))


def _precedences(spark, n: int, p: float, seed: int):
    jobs, g = generate.precedences(spark, n, seed % (2**31 - 2) + 1, p)
    of = F.lit(1).cast("long").alias("graph_id")
    arcs = g.edges.select(of, "src", "dst", F.col("dst").alias("adj"))
    return _one(jobs, job=F.col("job"), p=F.col("p")), g.vertices.select(of, "id"), arcs


def _weighted(spark, n: int, p: float, seed: int) -> Graph:
    return generate.undirected(spark, n, p, seed, weights=(0, max(1, int(n * n * p) // 4)))


def _log(spark, n: int, seed: int) -> DataFrame:
    return generate.access_log(spark, 200_000_000, n, seed)


def _scheduled(order: str) -> Callable:
    def solve(x):
        jobs, vertices, arcs = x
        found = search.topological_order(vertices, arcs, order)
        return scheduling.in_order(jobs, found.select(F.col("graph_id").alias("instance_id"), "seq", F.col("v").alias("job")))

    return solve


def _both_ways(names: tuple[str, str], solve: Callable) -> list[Algorithm]:
    """A whole result, and the same rows pulled one by one."""
    return [Algorithm(names[0], solve), Algorithm(names[1], lambda x: solve(x).orderBy("seq"), enumerates=True)]


_SOURCE = lambda g: distances.single_source(g, 0)
_SOURCE_ENUM = lambda g: distances.enumerate_single_source(g, 0).orderBy("seq")
#: Algorithms by problem.
SETS: dict[str, list[Algorithm]] = {
    "sorting": [Algorithm("total-sort", lambda df: df.orderBy("value")), Algorithm("enum-iqs", lambda df: _in_order(df, F.col("value")), enumerates=True), Algorithm("enum-ihs", lambda df: _in_order(df, F.col("value").desc()), enumerates=True)],
    "lazy-array": [Algorithm("total-lazy-array", matrix.replay)],
    "f2-cmax": _both_ways(("total-unstable-sort", "enum-iqs"), scheduling.two_machine_flow_shop),
    "rj-cmax": _both_ways(("total-unstable-sort", "enum-iqs"), scheduling.one_machine),
    "p-cmax": [Algorithm("total-lpt", lambda x: scheduling.longest_first(*x))] + [Algorithm(n, lambda x: scheduling.enumerate_longest_first(*x).orderBy("seq"), enumerates=True) for n in ("enum-lpt", "enum-lpt-coroutine")],
    "prec-cmax": [Algorithm("enum-topo-sort", lambda x: _scheduled("sources")(x).orderBy("seq"), enumerates=True), Algorithm("total-idfs-finish-time", _scheduled("finish")), Algorithm("total-dfs-finish-time", _scheduled("finish"))],
    "sssd-unweighted": [Algorithm("bfs", _SOURCE), Algorithm("enum-bfs", _SOURCE_ENUM, enumerates=True), Algorithm("enum-bfs-lazy", _SOURCE_ENUM, enumerates=True)],
    "sssd-weighted": [Algorithm("dijkstra", lambda g: distances.single_source(g, 0, True)), Algorithm("enum-dijkstra", lambda g: distances.enumerate_single_source(g, 0, True).orderBy("seq"), enumerates=True)],
    "apsd-unweighted": [Algorithm("apsd-bfs", distances.all_pairs), Algorithm("apsd-bfs-visit", distances.all_pairs), Algorithm("apsd-enum-bfs", distances.enumerate_all_pairs, enumerates=True), Algorithm("apsd-enum-bfs-no-self", distances.enumerate_no_self, enumerates=True), Algorithm("apsd-enum-bfs-sorted", lambda g: distances.enumerate_sorted(g).orderBy("seq"), enumerates=True)],
    "apsd-weighted": [Algorithm("apsd-dijkstra", lambda g: distances.all_pairs(g, True)), Algorithm("apsd-fw", distances.floyd_warshall), Algorithm("apsd-enum-dijkstra", lambda g: distances.enumerate_all_pairs(g, True), enumerates=True), Algorithm("apsd-enum-dijkstra-no-self", lambda g: distances.enumerate_no_self(g, True), enumerates=True), Algorithm("apsd-enum-dijkstra-sorted", lambda g: distances.enumerate_sorted(g, True).orderBy("seq"), enumerates=True)],
    "mst": [Algorithm("total-boruvka", mst.spanning_forest), Algorithm("total-kruskal-iqs", mst.kruskal_by_parts), Algorithm("total-kruskal-rustsort", mst.kruskal_by_parts), Algorithm("total-prim", mst.prim_forest)]
    + [Algorithm("incremental-boruvka", lambda g: mst.spanning_forest(g).orderBy("round"), enumerates=True), Algorithm("incremental-kruskal", lambda g: mst.kruskal_order(mst.kruskal_by_parts(g)).orderBy("seq"), enumerates=True), Algorithm("incremental-prim", lambda g: mst.prim_order(mst.spanning_forest(g)).orderBy("component", "seq"), enumerates=True)]
    + [Algorithm(n, lambda g, s=s: mst.enumerate_forest(g, s), enumerates=True) for n, s in (("enum-boruvka", None), ("enum-kruskal", mst.kruskal_by_parts), ("enum-prim", mst.prim_forest))],
}

_GRAPHS = _steps(100, 200_000)
_PAIRS = _steps(100, 10_000)
_CLIQUES = _steps(100, 30_000)
_MOTORWAYS = {"highway": ["motorway", "motorway_link"]}

#: The experiment sets by the names they are run by.
EXPERIMENTS: dict[str, ExperimentSet] = {
    x.name: x
    for x in (
        ExperimentSet("f2_cmax", SETS["f2-cmax"], _sizes(_steps(10**4, 3 * 10**9), _flow_shop)),
        ExperimentSet("rj_cmax", SETS["rj-cmax"], _sizes(_steps(10**4, 3 * 10**9), _releases)),
        ExperimentSet("p_cmax", SETS["p-cmax"], _machines),
        ExperimentSet("prec_cmax", SETS["prec-cmax"], _graphs(_GRAPHS, MOST_EDGES, _precedences)),
        ExperimentSet("mst", SETS["mst"], _graphs(_GRAPHS, 0.75 * MOST_EDGES, _weighted)),
        ExperimentSet("sssd_u_osm", SETS["sssd-unweighted"], _roads(False)),
        ExperimentSet("sssd_w_osm", SETS["sssd-weighted"], _roads(True)),
        ExperimentSet("sssd_u_a", SETS["sssd-unweighted"], _both(_graphs(_GRAPHS, 0.5 * MOST_EDGES, generate.undirected), _worst(_CLIQUES))),
        ExperimentSet("sssd_w_a", SETS["sssd-weighted"], _graphs(_GRAPHS, 0.5 * MOST_EDGES, _weighted)),
        ExperimentSet("apsd_u_osm", SETS["apsd-unweighted"], _roads(False, **_MOTORWAYS), 1),
        ExperimentSet("apsd_w_osm", SETS["apsd-weighted"], _roads(True, **_MOTORWAYS), 1),
        ExperimentSet("apsd_u_a", SETS["apsd-unweighted"], _both(_graphs(_PAIRS, MOST_EDGES, generate.undirected), _worst(_CLIQUES))),
        ExperimentSet("apsd_w_a", SETS["apsd-weighted"], _graphs(_PAIRS, MOST_EDGES, _weighted)),
        ExperimentSet("lazy_array", SETS["lazy-array"], _sizes(_steps(10, 9 * 10**7), _log), 1),
        ExperimentSet("sort", SETS["sorting"], _sizes(_steps(10, 9 * 10**7), generate.elements)),
    )
}
