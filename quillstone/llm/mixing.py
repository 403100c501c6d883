"""Mixing sources to target weights by budgets in a domain-language-source tree.

A token budget flows down the tree: each node's children share it by their weights. A
child that can't use its share (its tokens times ``max_epochs``) is filled up and what it
leaves goes to its siblings, by weight; only what all siblings together can't use goes
back to their parent's siblings. A leaf with budget B and T tokens is taken ``B // T``
times whole, and of the next epoch, whose order comes from the seed, the longest prefix
of documents within the remaining tokens is taken.

Only leaf totals reach the driver: one row for each domain, language and source. A leaf
of any size is cut in three steps: sums over buckets of the seeded order, the bucket that
holds the cut, and the exact order inside that bucket alone. Nothing sorts a whole leaf.

Null and missing languages, sources and domains are leaves of their own. Null and empty
texts have no tokens: they never fill a budget, and are taken with the whole epochs of
their leaf and with a prefix that reaches them. Rows that repeat are documents of their
own. Without any token nothing is taken. Texts of any length count whole. Tables need the
columns ``doc_id``, ``text``, ``lang`` and ``source`` and raise without them; others pass through,
whatever their names. The tree has at most ``MAX_LEAVES`` leaves, which bounds what the driver
gets; a corpus with more raises, and needs sources merged before it is mixed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.quality import words
from quillstone.runtime import cut

BUCKETS = 4096
MAX_LEAVES = 1_000_000
NONE = "(none)"


def default_domain(source: Column) -> Column:
    """Domain of a source: sources are numbered, those of ten and more form the second domain."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.when(number == "", NONE).when(F.length(number) > 1, "wide").otherwise("core")


@dataclass(frozen=True)
class Plan:
    """Production parameters. ``weights`` maps a path (domain, domain/lang, domain/lang/source) to
    its weight among its siblings; a path that isn't named weighs 1."""

    weights: tuple[tuple[str, float], ...] = (
        ("core", 3.0), ("wide", 2.0),
        ("core/en", 5.0), ("core/de", 2.0), ("core/fr", 2.0), ("core/es", 1.0),
        ("wide/en", 4.0), ("wide/de", 2.0), ("wide/fr", 2.0), ("wide/es", 2.0),
    )
    #: Budget in tokens as a share of all tokens.
    share: float = 1.0
    max_epochs: int = 2
    seed: int = 17
    domain: Callable[[Column], Column] = default_domain


def split_budget(budget: int, children: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Budgets of siblings from (weight, capacity); whole tokens, never over a capacity.

    Shortages are shared again among the siblings that have room, until all is placed or
    all are full.
    """
    got = {k: 0 for k in children}
    left, room = int(budget), {k for k, (w, c) in children.items() if c > 0 and w > 0}
    while left > 0 and room:
        total = sum(children[k][0] for k in room)
        full = {k for k in room if left * children[k][0] / total >= children[k][1] - got[k]}
        if full:
            for k in full:
                left -= children[k][1] - got[k]
                got[k] = children[k][1]
            room -= full
            continue
        parts = {k: left * children[k][0] / total for k in room}
        for k, x in parts.items():
            got[k] += int(x)
        rest = left - sum(int(x) for x in parts.values())
        # single tokens go to the largest fractions, then by name
        for k in sorted(room, key=lambda k: (int(parts[k]) - parts[k], k)):
            if rest and got[k] < children[k][1]:
                got[k] += 1
                rest -= 1
        break
    return got


def allocate(leaves: dict[tuple[str, str, str], int], plan: Plan) -> dict[tuple[str, str, str], int]:
    """Token budget of every leaf, from the tokens it has."""
    weights = dict(plan.weights)
    budget = int(sum(leaves.values()) * plan.share)
    room = {k: n * plan.max_epochs for k, n in leaves.items()}
    level = {(): budget}
    for depth in range(3):
        below = {}
        for path, b in level.items():
            kids: dict[str, int] = {}
            for k, c in room.items():
                if k[:depth] == path:
                    kids[k[depth]] = kids.get(k[depth], 0) + c
            shares = split_budget(b, {x: (weights.get("/".join((*path, x)), 1.0), c) for x, c in kids.items()})
            below |= {(*path, x): n for x, n in shares.items()}
        level = below
    return level


def _keyed(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` in ``row`` beside the leaf's names and a hash of the row that orders epochs."""
    name = lambda c: F.coalesce(F.col(c), F.lit(NONE))
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.coalesce(plan.domain(F.col("source")), F.lit(NONE)).alias("domain"),
        name("lang").alias("lang"),
        name("source").alias("source"),
        F.xxhash64("doc_id", "text").alias("own"),
    )


LEAF = ["domain", "lang", "source"]


def with_copies(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(row, domain, lang, source, copies, budget)``: how often every row is taken."""
    keyed = _keyed(docs, plan)
    n_tokens = F.size(words(F.col("row.text"))).cast("long")
    narrow = cut(keyed.select(*LEAF, "own", n_tokens.alias("n")))
    totals = narrow.groupBy(*LEAF).agg(F.sum("n").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError("too many leaves")
    leaves = {(r.domain, r.lang, r.source): r.n for r in totals}
    budgets = allocate(leaves, plan)
    rows = [(*k, b // leaves[k] if leaves[k] else 0, b % leaves[k] if leaves[k] else 0, b) for k, b in budgets.items()]
    spark = docs.sparkSession
    # bounded by MAX_LEAVES
    shares = F.broadcast(spark.createDataFrame(rows, "domain string, lang string, source string, whole long, rest long, budget long"))
    order = lambda: F.xxhash64(F.lit(plan.seed), F.col("whole"), F.col("own"))
    bucket = lambda: F.pmod(F.shiftrightunsigned("at", 40), F.lit(BUCKETS))

    placed = narrow.join(shares, LEAF).filter("rest > 0").withColumn("at", order()).withColumn("bucket", bucket())
    sums = placed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .filter("before <= rest and before + n > rest")
        .select(*LEAF, F.col("bucket").alias("cut"), "before")
    )
    cuts = F.broadcast(cut(cuts))  # at most one row a leaf
    w = Window.partitionBy(*LEAF).orderBy("at", "own").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        placed.join(cuts, LEAF)
        .filter("bucket = cut")
        .withColumn("sum", F.col("before") + F.sum("n").over(w))
        .withColumn("of", F.count("*").over(Window.partitionBy(*LEAF, "at", "own")))
        .filter("sum <= rest")
        .groupBy(*LEAF, "at", "own")
        .agg(F.count("*").alias("fit"), F.max("of").alias("of"))
        .groupBy(*LEAF)
        .agg(F.max(F.struct("at", "own", "fit", "of")).alias("e"))
        .select(*LEAF, F.struct("e.at", "e.own").alias("last"), "e.fit", "e.of")
    )
    edge = cut(edge)  # at most one row a leaf
    parted = edge.filter("fit < of").limit(1).count() > 0
    edge = F.broadcast(edge)
    found = (
        keyed.join(shares, LEAF, "left")
        .withColumn("at", order())
        .withColumn("bucket", bucket())
        .join(cuts, LEAF, "left")
        .join(edge, LEAF, "left")
    )
    inside = F.struct(F.col("at"), F.col("own")) <= F.col("last")
    partial = (F.col("rest") > 0) & F.coalesce((F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & inside), F.lit(False))
    copies = lambda partial: (F.col("whole") + partial.cast("long")).alias("copies")
    if not parted:
        return found.select("row", *LEAF, copies(partial), "budget")
    # the cut falls among rows that repeat: as many of them as fit are taken
    tie = F.coalesce((F.struct(F.col("at"), F.col("own")) == F.col("last")) & (F.col("fit") < F.col("of")), F.lit(False))
    tied = found.filter(tie).withColumn("nth", F.row_number().over(Window.partitionBy(*LEAF).orderBy("at")))
    others = found.filter(~tie).select("row", *LEAF, copies(partial), "budget")
    return others.unionByName(tied.select("row", *LEAF, copies(F.col("nth") <= F.col("fit")), "budget"))


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows taken, each as often as its epochs say, with the columns of ``docs``."""
    taken = with_copies(docs, plan).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
