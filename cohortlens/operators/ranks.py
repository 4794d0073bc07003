"""Ranks and running windows (O-56 … O-60) without a single-task global window.

A global order (percentile rank over the whole table, a running mean over all
records) is computed in two levels: the data is range-partitioned on the order
key, each range computes its local prefix, and a table with one row per range
(bounded by the partition count, a parameter) supplies the offsets.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import cents, half_even_div


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order_cols: list[str], parts: int | None = None) -> DataFrame:
    """Range-partition on `order_cols`, tag each row with its range number and
    materialise, so the tags stay fixed if a task is retried."""
    from ..plans.curated import materialise

    p = _parts(df, parts)
    tagged = df.repartitionByRange(p, *order_cols).withColumn("__part", F.spark_partition_id())
    return materialise(tagged, "ranged")


def prefix_sums(df: DataFrame, order_cols: list[str], values: dict[str, Column],
                parts: int | None = None, inclusive: bool = True, groups=(),
                with_totals: bool = False) -> DataFrame:
    """Adds `<name>` = running sum of each value over the global order (ties in
    the order columns must be broken by the caller, e.g. with a key).

    With `groups` (a prefix of `order_cols`) the sums restart in every group and
    `with_totals` adds `<name>_total`, the group's sum.  Each range computes its
    local sums per group; the offsets come from the (range, group) totals, a
    table of at most ranges + groups rows, so a group spread over many ranges
    is still summed in parallel."""
    g = list(groups)
    assert order_cols[:len(g)] == g, "groups must lead the order"
    base = df.withColumns({f"__v_{k}": v for k, v in values.items()})
    r = ranged(base, order_cols, parts)
    w = Window.partitionBy("__part", *g).orderBy(*order_cols)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = r.withColumns({
        f"__l_{k}": F.coalesce(F.sum(f"__v_{k}").over(frame), F.lit(0)) for k in values
    })
    totals = r.groupBy("__part", *g).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
    # earlier ranges of the same group; without groups one row per range
    wo = Window.partitionBy(*g).orderBy("__part")
    cum = [F.coalesce(F.sum(f"__t_{k}").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
           .alias(f"__o_{k}") for k in values]
    tot = [F.sum(f"__t_{k}").over(Window.partitionBy(*g)).alias(f"__n_{k}") for k in values] if with_totals else []
    offsets = totals.select("__part", *[F.col(c).alias(f"__g_{c}") for c in g], *cum, *tot)
    if g:
        cond = reduce(lambda a, b: a & b, [local[c].eqNullSafe(offsets[f"__g_{c}"]) for c in g],
                      local["__part"] == offsets["__part"])
        out = local.join(offsets, cond)  # AQE broadcasts it when the group count allows
    else:
        out = local.join(F.broadcast(offsets), "__part")  # one row per range
    return out.select(
        *[local[c] for c in df.columns], *[(F.col(f"__l_{k}") + F.col(f"__o_{k}")).alias(k) for k in values],
        *[F.col(f"__n_{k}").alias(f"{k}_total") for k in values if with_totals],
    )


def value_counts_before(df: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """Per distinct value: its count and the number of rows with a smaller value."""
    vc = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))
    return prefix_sums(vc, [col], {"before": F.col("cnt")}, parts, inclusive=False)


def value_counts_before_multi(df: DataFrame, cols, parts: int | None = None, by=(),
                              keep: bool = True) -> DataFrame:
    """(by…, field, value, cnt, before, n) for several columns from one scan: the
    columns are unpivoted to (field, value), counted per distinct value, and one
    two-level prefix sum per (by…, field) group runs over the values (see
    `prefix_sums`).  `keep` writes the table to the shared folder, for callers
    that read it more than once."""
    by = list(by)
    pairs = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("p")).select(*by, "p.*").filter(F.col("value").isNotNull())
    vc = pairs.groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias("cnt"))
    out = prefix_sums(vc, [*by, "field", "value"], {"before": F.col("cnt")}, parts, inclusive=False,
                      groups=[*by, "field"], with_totals=True).withColumnRenamed("before_total", "n")
    if not keep:
        return out
    # one row per distinct value: written once, then joined as often as needed
    from ..plans.curated import materialise
    return materialise(out, "value-prefix")


def exact_quantiles(df: DataFrame, cols, probs, by=(), parts: int | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation between the values at ranks
    floor/ceil of p·(n−1), as Spark's `percentile`) of several columns, per
    group of `by`: (by…, field, q0, q1, …).

    Unlike `percentile` no group's value→count map is merged in one task: the
    distinct values are counted (combinable) and prefix-summed across range
    partitions, and each quantile reads the at most two distinct-value rows
    whose rank interval holds floor/ceil of its position.
    """
    by = list(by)
    vb = value_counts_before_multi(df, cols, parts, by, keep=False)  # read once, by the filter below
    hit, picks, out = [], [], []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1).cast("double") * float(p)
        lo, hi = F.floor(pos), F.ceil(pos)
        in_lo = (F.col("before") <= lo) & (lo < F.col("before") + F.col("cnt"))
        in_hi = (F.col("before") <= hi) & (hi < F.col("before") + F.col("cnt"))
        hit += [in_lo, in_hi]
        picks += [F.max(F.when(in_lo, F.col("value"))).alias(f"__lo{i}"),
                  F.max(F.when(in_hi, F.col("value"))).alias(f"__hi{i}")]
        out.append(F.when(hi == lo, F.col(f"__lo{i}")).otherwise(
            (hi - pos) * F.col(f"__lo{i}") + (pos - lo) * F.col(f"__hi{i}")).alias(f"q{i}"))
    sel = vb.filter(reduce(lambda a, b: a | b, hit))
    return sel.groupBy(*by, "field", "n").agg(*picks).select(*by, "field", *out)


# ---------------------------------------------------------------- O-56
def percentile_rank(df: DataFrame, key: str, cols, scale: float = 100.0, digits: int = 1,
                    parts: int | None = None) -> DataFrame:
    """Average-tie percentile rank over the whole table: (before + (cnt+1)/2)/n.

    The distinct-value table is joined back to the rows on the value; AQE turns
    it into a broadcast when the distinct table is small at run time and
    splits skewed values otherwise.
    """
    out = df.select(key, *cols)
    vb = value_counts_before_multi(df, cols, parts)
    # exact half-even rounding of (before + (cnt+1)/2) / n * scale at `digits` places,
    # done on integers so no engine's float noise decides a tie
    mult = int(round(scale * 10 ** digits))
    vb = vb.withColumns({"__num": (2 * F.col("before") + F.col("cnt") + 1) * F.lit(mult),
                         "__den": (2 * F.col("n")).cast("bigint")})
    vb = vb.select("field", "value", (half_even_div("__num", "__den") / float(10 ** digits)).alias("pct"))
    for c in cols:
        ranks = vb.filter(F.col("field") == c).select(F.col("value").alias(f"__k_{c}"), F.col("pct").alias(f"pct_{c}"))
        out = out.join(ranks, out[c].cast("double") == ranks[f"__k_{c}"], "left").drop(f"__k_{c}")
    return out.select(key, *[f"pct_{c}" for c in cols])


# ---------------------------------------------------------------- O-57
def ecdf_at(df: DataFrame, col: str, value: float) -> Column:
    """Share of rows with col <= value, ×100 (an aggregate expression)."""
    return F.avg(F.when(F.col(col) <= value, 1.0).otherwise(0.0)) * 100


# ---------------------------------------------------------------- O-58
def running_error(df: DataFrame, order_cols: list[str], predicted: str, actual: str,
                  parts: int | None = None) -> DataFrame:
    """Running mean absolute error (2 dp, half-even) and running count, in the
    order of `order_cols`; only rows with an actual value take part."""
    v = df.filter(F.col(actual).isNotNull())
    err_c = F.abs(cents(F.col(actual)) - cents(F.col(predicted)))
    v = v.withColumn("error_cents", err_c)
    s = prefix_sums(v, order_cols, {"sum_cents": F.col("error_cents"), "n_so_far": F.lit(1).cast("bigint")}, parts)
    return s.select(
        *[c for c in df.columns],
        (F.col("error_cents") / 100.0).alias("error"),
        (half_even_div("sum_cents", "n_so_far") / 100.0).alias("cumulative_mae"),
        F.col("n_so_far"),
    )


# ---------------------------------------------------------------- O-59/O-60
def linear_fit(ys: list[Column]) -> tuple[Column, Column]:
    """Least-squares line through (1, y1) … (k, yk)."""
    k = len(ys)
    xs = list(range(1, k + 1))
    sx = float(sum(xs))
    sxx = float(sum(x * x for x in xs))
    sy = reduce(lambda a, b: a + b, ys)
    sxy = reduce(lambda a, b: a + b, [y * float(x) for x, y in zip(xs, ys)])
    denom = k * sxx - sx * sx
    slope = (sxy * float(k) - sy * sx) / denom
    intercept = (sy - slope * sx) / float(k)
    return slope, intercept


def trend_projection(df: DataFrame, periods: list[str], by: list[str] | None = None,
                     lo: float = 0.0, hi: float = 20.0, dead_band: float = 0.05) -> DataFrame:
    """Period means per group, their linear trend, a one-step projection
    clamped to [lo, hi] and a direction with a dead band."""
    by = by or []
    means = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(f"mean_{p}") for p in periods]
    )
    slope, intercept = linear_fit([F.col(f"mean_{p}") for p in periods])
    k = len(periods)
    proj = F.least(F.greatest(intercept + slope * float(k + 1), F.lit(lo)), F.lit(hi))
    direction = F.when(slope > dead_band, "improving").when(slope < -dead_band, "worsening").otherwise("stable")
    return means.select(*by, "n", *[f"mean_{p}" for p in periods], slope.alias("slope"),
                        intercept.alias("intercept"), proj.alias("projected"), direction.alias("direction"))
