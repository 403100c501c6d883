"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document. A bounded sample gives every rule's cost (time a row) and
selectivity (share rejected); rules then run in the order of rejection per cost, inside
one CASE expression, so that a rejected document pays for no later rule. The verdict is
the same in any order; only the time differs.

Words are runs of characters other than space and U+0009 to U+000D. Null texts count as
empty. Repeated rows are judged alike and all kept or all rejected; extra columns pass
through untouched, whatever their names. Texts of any length are judged whole, each in one
row's expressions, so a task holds the words of a text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.runtime import cut, let

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample that sets the order of the rules; it never sets their verdict.
SAMPLE_ROWS = 2000
#: Times that a rule is run on the sample; its cost is the least of them.
REPEATS = 3


def words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(w: Column, n: int = 3) -> Column:
    """Words inside ``n``-word windows that occur at least twice, first occurrence included.

    Windows are compared by 64-bit hash. Texts without a repeated window, the most of
    them, are settled by one hash set; only others sort their windows.
    """
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
    )

    def covered(s: Column) -> Column:
        twin = F.filter(
            s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
        )
        at = F.sort_array(F.transform(twin, lambda x: x["i"]))
        return let(
            at,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    count = let(
        hashed,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ),
    )
    return F.when(F.size(w) < n, F.lit(0)).otherwise(count).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a feature lookup to a boolean Column; features are built on demand."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def features(text: Column, w: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": word_chars(w),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_lines": F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long"),
        "n_repeat_words": n_repeat_words(w),
        "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"),
    }


#: Production rules; all bounds are inclusive on the kept side.
RULES = (
    Rule("few_words", lambda f: f("n_words") < 50),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
    Rule("symbols", lambda f: 10 * f("n_symbols") > 3 * f("n_words")),
    Rule("repeated_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
    Rule("no_letters", lambda f: 10 * f("n_letter_words") < 6 * f("n_words")),
)


def rank_rules(df: DataFrame, text: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules with ``cost`` (seconds a row) and ``rejected`` (share), best rejection per cost first.

    The sample is spread over the whole table and holds ``rows`` rows in the mean and
    twice that at most. On an empty table the rules keep their given order.
    """
    total = df.count()
    if not total:
        return [{"rule": r, "cost": 0.0, "rejected": 0.0} for r in rules]
    share = min(1.0, rows / total)
    sample = cut(
        df.select(F.col(text).alias("t")).sample(share, seed=7).limit(2 * rows).select("t", words(F.col("t")).alias("w"))
    )
    def spent(*agg: Column) -> tuple[float, tuple]:
        """Least time of a job on the sample, after one that warms it up."""
        got, best = sample.agg(*agg).first(), float("inf")
        for _ in range(REPEATS):
            began = time.perf_counter()
            sample.agg(*agg).first()
            best = min(best, time.perf_counter() - began)
        return best, got

    fixed, _ = spent(F.count(F.size("w")))  # what any job takes
    out = []
    for r in rules:
        f = features(F.col("t"), F.col("w"))
        took, (hit, n) = spent(F.count_if(r.rejects(f.__getitem__)), F.count("*"))
        out.append({"rule": r, "cost": max(took - fixed, 1e-6) / max(n, 1), "rejected": hit / max(n, 1)})
    return sorted(out, key=lambda x: (-x["rejected"] / x["cost"], x["rule"].name))


def cascade(ranked: list[dict], feature: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, or null."""
    out = None
    for x in ranked:
        hit = x["rule"].rejects(feature)
        out = F.when(hit, F.lit(x["rule"].name)) if out is None else out.when(hit, F.lit(x["rule"].name))
    return F.lit(None).cast("string") if out is None else out


def keep_quality(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Rows of ``df`` that no rule rejects, with all their columns."""
    ranked = rank_rules(df, text, rules)
    # the words are bound once; a column of them would be put in for every use by the optimiser
    rejected = let(words(F.col(f"`{text}`")), lambda w: cascade(ranked, features(F.col(f"`{text}`"), w).__getitem__))
    return df.filter(rejected.isNull())


#: Features that a report always has; others are worked out only where the cascade comes to them.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(df: DataFrame, text: str = "text", rules=RULES, name: str = "q") -> DataFrame:
    """``df`` with a struct of the ``REPORTED`` features and of the cascade's verdict appended,
    under ``name``; where ``df`` has such a column, under that name with as many underscores
    before it as make it a new one."""
    ranked = rank_rules(df, text, rules)
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    row = [F.col(f"`{c}`") for c in df.columns]

    def report(w: Column) -> Column:
        f = features(F.col(f"`{text}`"), w)

        def judged(q: Column) -> Column:
            verdict = cascade(ranked, lambda k: q.getField(k) if k in REPORTED else f[k])
            return F.struct(*[q.getField(k).alias(k) for k in REPORTED], verdict.alias("rejected_by"))

        return let(F.struct(*[f[k].alias(k) for k in REPORTED]), judged)

    return df.select(*row, let(words(F.col(f"`{text}`")), report).alias(name))
