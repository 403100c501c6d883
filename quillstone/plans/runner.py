"""Experiments: named algorithms over named instances, timed, with results as tables."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators.graph import Graph
from quillstone.sources import files

RUN = "algorithm string, parameters string, size int, instance_seed string, run int"
MEASUREMENT = RUN + ", total_time long, quality double"
ENUMERATION = RUN + ", preprocessing long, first_output long, delays long, delay_min double, delay_max double, delay_avg double, delay_inc_max double, quality double"


@dataclass(frozen=True)
class Algorithm:
    """A function from an instance to a DataFrame; ``quality`` maps that result to a number. Rows of
    one that ``enumerates`` are pulled in order, and what is measured is when each came."""

    name: str
    solve: Callable[..., DataFrame]
    quality: Callable[[DataFrame], float] | None = None
    enumerates: bool = False


@dataclass
class Options:
    runs: int = 5
    seed: int = 42
    max_size: int | None = None
    transform: Callable | None = None
    log: Callable[[str], None] = print
    #: Functions from an instance to a table about it, or None; written beside the measurements.
    statistics: list[Callable] = field(default_factory=list)
    #: Folder that instances are kept in.
    cache: str | None = None
    #: Folder of road graphs for the sets that read them.
    data: str | None = None


@dataclass(frozen=True)
class Cell:
    """A place of an experiment's grid: ``make(spark, seed)`` gives an instance."""

    size: int
    parameters: str
    make: Callable[[SparkSession, int], object]


@dataclass(frozen=True)
class ExperimentSet:
    name: str
    algorithms: list[Algorithm]
    grid: Callable[[SparkSession, Options], Iterable[Cell]]
    instances: int = 10
    runs: int = 5
    transform: Callable | None = None


def emitted(rows: Iterable, clock: Callable[[], int] = time.perf_counter_ns, began: int | None = None) -> Iterator[tuple[int, int]]:
    """``(seq, t)`` of pulled parts, in nanoseconds since ``began``; part 0 is the end of preprocessing."""
    began = clock() if began is None else began
    it = iter(rows)
    yield 0, clock() - began
    for k, _ in enumerate(it, 1):
        yield k, clock() - began


def delays(times: Iterable[tuple[int, int]]) -> tuple:
    """``(preprocessing, first_output, delays, delay_min, delay_max, delay_avg, delay_inc_max)`` of
    ``(seq, t)`` in order, keeping a few numbers however many parts there are; see
    ``emissions.measures`` for the same over a table of them."""
    start = last = first = least = most = most_inc = None
    n = 0
    for seq, t in times:
        if not seq:
            start = t
        else:
            n, d = n + 1, t - last
            first = t if first is None else first
            least, most = (d, d) if least is None else (min(least, d), max(most, d))
            inc = (t - start) / seq
            most_inc = inc if most_inc is None else max(most_inc, inc)
        last = t
    if not n:
        return start, None, 0, None, None, None, None
    return start, first, n, float(least), float(most), (last - start) / n, float(most_inc)


def measure(spark: SparkSession, algorithms: list[Algorithm], instance, parameters: str, size: int, seed: str, options: Options) -> tuple[DataFrame, DataFrame]:
    """A row for each run, of whole results and of enumerations. Algorithms run in a fresh seeded
    order every time; one that fails is reported and skipped."""
    rng, totals, enums = random.Random(options.seed), [], []
    given = options.transform(instance) if options.transform else instance
    for run in range(options.runs):
        for a in rng.sample(algorithms, len(algorithms)):
            key = (a.name, parameters, size, seed, run)
            try:
                began = time.perf_counter_ns()
                out = a.solve(given)
                if a.enumerates:
                    row = delays(emitted(out.toLocalIterator(prefetchPartitions=True), began=began))
                    enums.append((*key, *row, float(a.quality(out)) if a.quality else None))
                else:
                    out.write.format("noop").mode("overwrite").save()
                    took = time.perf_counter_ns() - began
                    totals.append((*key, took, float(a.quality(out)) if a.quality else None))
            except Exception as e:  # noqa: BLE001
                options.log(f"{a.name}: {e}")
    return spark.createDataFrame(totals, MEASUREMENT), spark.createDataFrame(enums, ENUMERATION)


def kept(spark: SparkSession, path: str, make: Callable[[], object]):
    """An instance at ``path``, made and written there if it isn't yet: a DataFrame, a graph, or a
    tuple of either. A graph's vertices and edges, and a tuple's parts, have folders of their own."""
    made: list = []

    def once():
        if not made:
            made.append(make())
        return made[0]

    try:
        shape = spark.read.text(f"{path}/shape").first()[0].split()
    except Exception:  # noqa: BLE001 - nothing is there yet
        got = once()
        parts = got if isinstance(got, tuple) else (got,)
        shape = ["tuple" if isinstance(got, tuple) else "one"] + [("graph-directed" if x.directed else "graph") if isinstance(x, Graph) else "table" for x in parts]
        for i, x in enumerate(parts):
            for k, df in {"vertices": x.vertices, "edges": x.edges}.items() if isinstance(x, Graph) else (("rows", x),):
                df.write.mode("overwrite").parquet(f"{path}/{i}/{k}")
        # the shape is written last: without it nothing is taken from the folder
        spark.createDataFrame([(" ".join(shape),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/shape")
    read = lambda i, k: spark.read.parquet(f"{path}/{i}/{k}")
    parts = tuple(read(i, "rows") if s == "table" else Graph(read(i, "vertices"), read(i, "edges"), directed=s == "graph-directed") for i, s in enumerate(shape[1:]))
    return parts if shape[0] == "tuple" else parts[0]


def run_grid(spark: SparkSession, algorithms: list[Algorithm], grid: Iterable[Cell], instances: int, options: Options, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All cells and instances; with a ``path`` measurements are appended to its folders ``total`` and
    ``enumeration`` (parquet) as they end, and statistics of instances are written to its folder
    ``statistics``."""
    whole = [spark.createDataFrame([], x) for x in (MEASUREMENT, ENUMERATION)]
    for cell in grid:
        if options.max_size is not None and cell.size > options.max_size:
            continue
        for k in range(instances):
            seed = options.seed * 1_000_003 + cell.size * 101 + k
            name = f"{cell.size}_{cell.parameters}_{seed}"
            make = lambda: cell.make(spark, seed)  # noqa: E731, B023
            instance = kept(spark, f"{options.cache}/{name}", make) if options.cache else make()
            for i, about in enumerate(options.statistics):
                if path and (found := about(instance)) is not None:
                    found.write.mode("overwrite").parquet(f"{path}/statistics/{name}/{i}")
            for j, (folder, rows) in enumerate(zip(("total", "enumeration"), measure(spark, algorithms, instance, cell.parameters, cell.size, str(seed), options))):
                if path and not rows.isEmpty():
                    rows.write.mode("append").parquet(f"{path}/{folder}")
                whole[j] = whole[j].unionByName(rows)
    return whole[0], whole[1]


def run_set(spark: SparkSession, algorithms: list[Algorithm], generate: Callable[[int, int], object], sizes: list[int], instances: int, options: Options, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``run_grid`` over sizes, with ``generate(size, seed)``."""
    grid = [Cell(n, "default", lambda _, seed, n=n: generate(n, seed)) for n in sizes]
    return run_grid(spark, algorithms, grid, instances, options, path)


def run_experiment(spark: SparkSession, experiment: ExperimentSet, options: Options, path: str | None = None, instances: int | None = None) -> tuple[DataFrame, DataFrame]:
    """An experiment set over its whole grid, as far as ``options.max_size``."""
    options.transform = options.transform or experiment.transform
    return run_grid(spark, experiment.algorithms, experiment.grid(spark, options), instances or experiment.instances, options, path)


def graph_statistics(instance) -> DataFrame | None:
    """Statistics of a graph, or of the first graph of a tuple; None of other instances."""
    for x in instance if isinstance(instance, tuple) else (instance,):
        if isinstance(x, Graph):
            return x.statistics()
    return None


def road_files(spark: SparkSession, options: Options) -> Iterator[tuple[str, int]]:
    """Paths and sizes in bytes of the road graphs below ``options.data``, smallest first."""
    if options.data:
        for r in files.listed(spark, options.data, ".osm.pbf").orderBy("length").toLocalIterator():
            yield r["path"], r["length"]
