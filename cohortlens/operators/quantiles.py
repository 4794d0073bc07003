"""Exact quantiles of bounded memory: bracket and refine.

Every wanted rank (floor and ceil of p·(n−1), per group and column) keeps a bracket of values
that is known to hold it.  A round is one combinable aggregate over the rows: the values inside
each open bracket are counted in `bins` equal parts, together with each part's least and greatest
value.  The part that holds the rank becomes the next bracket; a part with one distinct value is
the answer.  No task ever holds a value→count map, and distinct values are neither sorted nor
shuffled: a round shuffles at most `bins` rows per open bracket and map task.

A bracket's ends fall in different parts, so every round narrows it.  Rounds cut it alternately by
difference and by ratio: two or three are usual, far outliers and crowded values take a few more,
and about fourteen are enough for any doubles.

Defined results: NULLs take no part; NaN counts as the greatest value and infinities in their
order, as in Spark's `percentile`; −0.0 is 0.0; a (group, column) without values has no row (None
from `column_quantiles`); NULL is a group like others; an empty table gives no rows.
"""
from __future__ import annotations

import math
from functools import reduce
from itertools import cycle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1024
_INF, _NAN = float("inf"), float("nan")


def _same(left: str, right: str, names) -> Column:
    cond = F.lit(True)
    for c in names:
        cond &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _half(x: Column) -> Column:
    """Even parts; halves keep every width finite."""
    return x / 2


def _octave(x: Column) -> Column:
    """Parts of even ratio, through zero: the sign and the binary logarithm, which is above -1075."""
    return F.coalesce(F.signum(x) * (F.log2(F.abs(x)) + 1100), F.lit(0.0))


def _part(x: Column, lo: Column, hi: Column, bins: int, scale) -> Column:
    """Part of [lo, hi] that holds x; the ends are apart by definition, whatever the scale's precision."""
    share = F.try_divide(scale(x) - scale(lo), scale(hi) - scale(lo))
    inner = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.5)) * bins), F.lit(0)), F.lit(bins - 1))
    return F.when(x <= lo, F.lit(0)).when(x >= hi, F.lit(bins - 1)).otherwise(inner).cast("int")


def _ends(x: Column) -> list[Column]:
    """What places every rank among the finite values: counts, and the least and greatest of them."""
    finite = ~F.isnan(x) & (F.abs(x) != _INF)
    return [F.count(x).alias("n"), F.count_if(x == -_INF).alias("below"), F.count_if(F.isnan(x)).alias("nans"),
            F.count_if(x == _INF).alias("above"), F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi")]


def _ranks(rows: DataFrame, keys: list[str], probs) -> DataFrame:
    """One row per wanted rank: its place among the finite values and the first bracket, or its value."""
    ends = rows.groupBy(*keys).agg(*_ends(F.col("value")))
    wanted = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1).cast("double") * float(p)
        wanted += [F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), at.alias("at"), f(at).cast("long").alias("rank"))
                   for s, f in (("lo", F.floor), ("hi", F.ceil))]
    r = ends.withColumn("w", F.explode(F.array(*wanted))).select("*", "w.*")
    value = (F.when(F.col("rank") < F.col("below"), F.lit(-_INF))
             .when(F.col("rank") >= F.col("n") - F.col("nans"), F.lit(_NAN))
             .when(F.col("rank") >= F.col("n") - F.col("nans") - F.col("above"), F.lit(_INF))
             .when(F.col("lo") == F.col("hi"), F.col("lo") + 0.0))
    return r.select(*keys, "i", "side", "at", (F.col("rank") - F.col("below")).alias("rank"), "lo", "hi", value.alias("value"))


def _refined(rows: DataFrame, ranks: DataFrame, keys: list[str], bins: int, scale) -> DataFrame:
    """One round: every open rank with the part of its bracket that holds it."""
    brackets = ranks.select(*keys, "lo", "hi").distinct()
    inside = rows.alias("r").join(brackets.alias("b"), _same("r", "b", keys) & F.col("r.value").between(F.col("b.lo"), F.col("b.hi")))
    inside = inside.select(*[F.col(f"b.{c}") for c in [*keys, "lo", "hi"]], "r.value")
    parts = inside.withColumn("part", _part(F.col("value"), F.col("lo"), F.col("hi"), bins, scale)).groupBy(*keys, "lo", "hi", "part").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("value").alias("least"), F.max("value").alias("most"))
    bracket = Window.partitionBy(*keys, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
    parts = parts.withColumn("before", F.coalesce(F.sum("cnt").over(bracket), F.lit(0)))
    held = (F.col("k.rank") >= F.col("p.before")) & (F.col("k.rank") < F.col("p.before") + F.col("p.cnt"))
    hit = ranks.alias("k").join(parts.alias("p"), _same("k", "p", [*keys, "lo", "hi"]) & held)
    return hit.select(*[F.col(f"k.{c}") for c in [*keys, "i", "side", "at"]], (F.col("k.rank") - F.col("p.before")).alias("rank"),
                      F.col("p.least").alias("lo"), F.col("p.most").alias("hi"),
                      F.when(F.col("p.least") == F.col("p.most"), F.col("p.least") + 0.0).alias("value"))


def exact_quantiles(df: DataFrame, cols, probs, by=(), bins: int = BINS) -> DataFrame:
    """(by…, field, q0, q1, …): quantiles of several columns, per group of `by`, with linear interpolation between
    the values at ranks floor/ceil of p·(n−1).

    `df` is read once more in every round, so pass a stored table.  The open ranks are a table in the shared folder;
    without groups they are a few numbers (`column_quantiles`)."""
    from ..plans.curated import materialise

    if not by:
        found = column_quantiles(df, cols, probs, bins)
        schema = ", ".join(["field string", *[f"q{i} double" for i in range(len(probs))]])
        return df.sparkSession.createDataFrame([(c, *q) for c, q in found.items() if q], schema)
    names = [f"by{i}" for i in range(len(by))]
    keys = [*names, "field"]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in cols])
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.inline(pairs)).where("value IS NOT NULL")
    ranks = materialise(_ranks(rows, keys, probs), "quantile-ranks")
    done, scales = [ranks.where("value IS NOT NULL")], cycle((_half, _octave))
    while not (ranks := ranks.where("value IS NULL")).isEmpty():
        ranks = materialise(_refined(rows, ranks, keys, bins, next(scales)), "quantile-ranks")
        done.append(ranks.where("value IS NOT NULL"))
    at = lambda i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("value")))
    place = lambda i: F.max(F.when(F.col("i") == i, F.col("at")))
    one = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(*[e for i in range(len(probs)) for e in (
        at(i, "lo").alias(f"lo{i}"), at(i, "hi").alias(f"hi{i}"), place(i).alias(f"at{i}"))])
    q = lambda i: F.when((F.floor(f"at{i}") == F.ceil(f"at{i}")) | (F.col(f"lo{i}") == F.col(f"hi{i}")), F.col(f"lo{i}")).otherwise(
        (F.ceil(f"at{i}") - F.col(f"at{i}")) * F.col(f"lo{i}") + (F.col(f"at{i}") - F.floor(f"at{i}")) * F.col(f"hi{i}"))
    return one.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "field", *[q(i).alias(f"q{i}") for i in range(len(probs))])


def column_quantiles(df: DataFrame, cols, probs, bins: int = BINS) -> dict[str, list[float] | None]:
    """Column → its quantiles (None without values).  A round is one aggregate of all columns; at most
    2 · columns · probabilities · `bins` parts reach the driver."""
    x = {c: F.col(c).cast("double") for c in cols}
    if not x:
        return {}
    ends = df.agg(*[F.struct(*_ends(v)).alias(c) for c, v in x.items()]).first()
    known: dict[tuple, float] = {}  # (column, rank) -> value
    held: dict[tuple, tuple] = {}  # (column, rank) -> bracket and the rank in it
    for c in x:
        e = ends[c]
        places = [(e["n"] - 1) * float(p) for p in probs] if e["n"] else []
        for r in {f(at) for at in places for f in (math.floor, math.ceil)}:
            if r < e["below"]:
                known[c, r] = -_INF
            elif r >= e["n"] - e["nans"]:
                known[c, r] = _NAN
            elif r >= e["n"] - e["nans"] - e["above"]:
                known[c, r] = _INF
            else:
                held[c, r] = e["lo"], e["hi"], r - e["below"]
    scales = cycle((_half, _octave))
    while True:
        known |= {k: lo + 0.0 for k, (lo, hi, _) in held.items() if lo == hi}
        held = {k: b for k, b in held.items() if k not in known}
        if not held:
            break
        open_ = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in held.items()})
        scale = next(scales)
        entries = [F.when(x[c].between(lo, hi), F.struct(F.lit(k).alias("k"), _part(x[c], F.lit(lo), F.lit(hi), bins, scale).alias("part"), x[c].alias("value")))
                   for k, (c, lo, hi) in enumerate(open_)]
        inside = df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        parts: dict[tuple, list] = {b: [] for b in open_}
        for p in inside.groupBy("k", "part").agg(F.count(F.lit(1)).alias("cnt"), F.min("value").alias("least"), F.max("value").alias("most")).collect():
            parts[open_[p["k"]]].append(p)
        for (c, r), (lo, hi, place) in held.items():
            for p in sorted(parts[c, lo, hi], key=lambda p: p["part"]):
                if place < p["cnt"]:
                    held[c, r] = p["least"], p["most"], place
                    break
                place -= p["cnt"]

    def quantile(c: str, at: float) -> float:
        below, above = math.floor(at), math.ceil(at)
        lo, hi = known[c, below], known[c, above]
        return lo if below == above or lo == hi else (above - at) * lo + (at - below) * hi

    return {c: [quantile(c, (ends[c]["n"] - 1) * float(p)) for p in probs] if ends[c]["n"] else None for c in x}


def column_medians(df: DataFrame, cols) -> dict[str, float | None]:
    return {c: q[0] if q else None for c, q in column_quantiles(df, cols, [0.5]).items()}
