"""Exploration (O-25 … O-29, O-38 … O-51): filters, paging, KPIs, group
profiles, histograms, column profiles and typical values.

Everything is one aggregate or one filter/sort; the only values brought to the
driver are the few scalars that become literals of the next stage (a min/max
pair for the histogram edges, a distinct count for the adaptive bin number).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.paging import numbered_page
from ..functions.topk import modes
from ..roles import Roles
from .quantiles import column_medians, exact_quantiles
from .ranks import exact_quantiles as prefix_quantiles


# ---------------------------------------------------------------- O-25
def subgroup_mask(roles: Roles, level_min=None, level_max=None, equals: dict | None = None) -> Column:
    """Range on the effort level plus optional equality tests (None = no test)."""
    parts = []
    if roles.effort and (level_min is not None or level_max is not None):
        lo = level_min if level_min is not None else float("-inf")
        hi = level_max if level_max is not None else float("inf")
        parts.append(F.col(roles.effort).between(lo, hi))
    for c, v in (equals or {}).items():
        if v is not None and v != "":
            parts.append(F.col(c) == v)
    if not parts:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def subgroup(df: DataFrame, roles: Roles, **kw) -> DataFrame:
    return df.filter(subgroup_mask(roles, **kw))


# ---------------------------------------------------------------- O-26
def explorer_page(df: DataFrame, roles: Roles, equals: dict | None = None, page: int = 1,
                  page_size: int = 20) -> tuple[int, int, int, DataFrame]:
    """Equality filters, total, page count (ceil), page clamped to 1..pages, one page.

    Returns (total, pages, page, rows).  Offset paging sorts by the key; for
    deep pages use `keyset_page`, which only needs the last key seen.
    """
    if page_size < 1:
        raise ValueError("page_size must be >= 1")
    return numbered_page(subgroup(df, roles, equals=equals), roles.id, page, page_size)


def keyset_page(df: DataFrame, roles: Roles, after_key, page_size: int = 20) -> DataFrame:
    f = df if after_key is None else df.filter(F.col(roles.id) > after_key)
    return f.orderBy(roles.id).limit(page_size)


# ---------------------------------------------------------------- O-27, O-28
def at_risk_top(df: DataFrame, roles: Roles, limit: int = 50, cols=None) -> DataFrame:
    """Lowest target first among at-risk rows (key breaks ties: TakeOrderedAndProject)."""
    cols = cols or [roles.id, *roles.categorical, roles.effort, roles.absences, roles.failures,
                    roles.target, "at_risk"]
    cols = [c for c in cols if c and c in df.columns]
    return df.filter(F.col("at_risk") == 1).orderBy(roles.target, roles.id).limit(limit).select(*cols)


# ---------------------------------------------------------------- O-29
def lookup(df: DataFrame, roles: Roles, key) -> DataFrame:
    return df.filter(F.col(roles.id) == key)


def lookup_many(df: DataFrame, roles: Roles, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch point lookup: (found rows, requested keys that do not exist)."""
    found = df.join(requests.select(roles.id), roles.id, "left_semi")
    missing = requests.join(df.select(roles.id), roles.id, "left_anti")
    return found, missing


# ---------------------------------------------------------------- O-38, O-48
def kpis(df: DataFrame, roles: Roles) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(roles.target).alias("mean_target"),
        F.avg("passed").alias("pass_rate"),
    ]
    if roles.effort:
        aggs.append(F.avg(roles.effort).alias("mean_effort"))
    if roles.absences:
        aggs.append(F.avg(roles.absences).alias("mean_absences"))
    return df.agg(*aggs)


def class_kpis(df: DataFrame, roles: Roles) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(roles.target).alias("mean_target"),
        F.avg("passed").alias("pass_rate"),
        F.sum("at_risk").cast("bigint").alias("n_at_risk"),
    ]
    if roles.failures:
        aggs.append(F.avg(roles.failures).alias("mean_failures"))
    if roles.absences:
        aggs.append(F.avg(roles.absences).alias("mean_absences"))
    return df.agg(*aggs)


# ---------------------------------------------------------------- O-39
def rate_by_level(df: DataFrame, roles: Roles, level: str | None = None) -> DataFrame:
    level = level or roles.effort
    return df.groupBy(level).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("passed").alias("pass_rate"),
        F.avg(roles.target).alias("mean_target"),
    )


def mean_by_category(df: DataFrame, roles: Roles, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.avg(roles.target).alias("mean_target"))


# ---------------------------------------------------------------- O-40
# Quantile methods: "bracket" — exact in bounded memory (`quantiles.exact_quantiles`, a few
# scans); "prefix" — exact and distributed (`ranks.exact_quantiles`, sorts the distinct values);
# "map" — exact, Spark's `percentile` (a value→count map per group, merged in one task per group: only
# for value domains of bounded size such as grades or counts);
# "approx" — bounded-memory sketch (`percentile_approx`).
QUANTILE_METHODS = ("bracket", "prefix", "map", "approx")


_BY_FIELD = {"bracket": exact_quantiles, "prefix": prefix_quantiles}


def _method(method: str | None, approx: bool) -> str:
    m = method or ("approx" if approx else "bracket")
    if m not in QUANTILE_METHODS:
        raise ValueError(f"unknown quantile method: {m}")
    return m


def quantiles(x: Column, probs, approx: bool = False, accuracy: int = 10000) -> Column:
    """Exact (linear interpolation, a value→count map per group) or, opt-in,
    approximate (bounded-memory sketch) quantiles as an array column."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return F.percentile_approx(x, arr, accuracy) if approx else F.percentile(x, arr)


def group_profile(df: DataFrame, value: str, by: str, approx: bool = False,
                  method: str | None = None) -> DataFrame:
    """Mean, count and quartiles of `value` per group; exact by default (see
    QUANTILE_METHODS for the choice at scale)."""
    if by not in df.columns:
        raise ValueError(f"unknown column: {by}")
    m = _method(method, approx)
    if m in _BY_FIELD:
        base = df.groupBy(by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
        q = _BY_FIELD[m](df, [value], (0.25, 0.5, 0.75), by=[by]).select(
            F.col(by).alias("__by"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
        # one row per group on both sides; groups whose values are all NULL keep NULL quartiles
        out = base.join(q, base[by].eqNullSafe(q["__by"]), "left")
        return out.select(by, "mean", "n", "q1", "median", "q3")
    q = quantiles(F.col(value), (0.25, 0.5, 0.75), m == "approx")
    return (
        df.groupBy(by)
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"), q.alias("_q"))
        .select(by, "mean", "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                F.col("_q")[2].alias("q3"))
    )


# ---------------------------------------------------------------- O-41
BANDS_DEFAULT = ((0.0, 1.5), (1.5, 3.0), (3.0, 5.0))


def banded_mean(df: DataFrame, roles: Roles, col: str, bands=BANDS_DEFAULT) -> DataFrame:
    """Mean target per right-closed band (lo, hi]; values outside every band and
    empty bands do not appear."""
    band = None
    for i, (lo, hi) in enumerate(bands):
        cond = (F.col(col) > lo) & (F.col(col) <= hi)
        band = F.when(cond, i) if band is None else band.when(cond, i)
    lo_e = reduce(lambda e, kv: e.when(F.col("band") == kv[0], kv[1][0]), enumerate(bands), F)
    hi_e = reduce(lambda e, kv: e.when(F.col("band") == kv[0], kv[1][1]), enumerate(bands), F)
    return (
        df.select(band.alias("band"), F.col(roles.target))
        .filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.avg(roles.target).alias("mean_target"), F.count(F.lit(1)).alias("n"))
        .select(F.col("band").cast("int"), lo_e.alias("band_lo"), hi_e.alias("band_hi"), "mean_target", "n")
    )


# ---------------------------------------------------------------- O-42, O-43, O-44
def bin_expr(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Right-closed equal-width bins 1..bins over [lo, hi]; the lowest edge is
    open by design but stretched (pandas `cut`), hence the clamp to 1."""
    w = (hi - lo) / bins
    if w == 0:
        return F.lit((bins + 1) // 2)
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((x - F.lit(lo)) / F.lit(w)))).cast("int")


def bin_edges(lo: float, hi: float, bins: int) -> list[tuple[int, float, float]]:
    if hi == lo:
        d = abs(lo) * 0.001 if lo != 0 else 0.001
        lo, hi = lo - d, hi + d
        edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    else:
        edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
        edges[0] = lo - (hi - lo) * 0.001
    return [(i + 1, edges[i], edges[i + 1]) for i in range(bins)]


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram with every bin present (empty bins count 0)."""
    spark = df.sparkSession
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if mm["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    counts = (
        df.filter(F.col(col).isNotNull())
        .select(bin_expr(F.col(col), lo, hi, bins).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    # the bin table has `bins` rows by construction (a parameter, not data)
    edges = spark.createDataFrame(bin_edges(lo, hi, bins), "bin int, bin_lo double, bin_hi double")
    return (
        F.broadcast(edges).join(counts, "bin", "left")
        .select("bin", "bin_lo", "bin_hi", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    )


def adaptive_bins(df: DataFrame, col: str) -> int:
    nd = df.agg(F.count_distinct(col).alias("d")).first()["d"] or 0
    return max(3, min(20, int(nd)))


def histogram_adaptive(df: DataFrame, col: str) -> DataFrame:
    return histogram(df, col, adaptive_bins(df, col))


def histogram_fixed(df: DataFrame, col: str, width: float = 2.0, nbins: int = 11) -> DataFrame:
    """Fixed-width bins from 0, the last bin absorbing everything above."""
    spark = df.sparkSession
    counts = (
        df.filter(F.col(col).isNotNull())
        .select(F.least(F.lit(nbins - 1), F.floor(F.col(col) / width)).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    edges = spark.range(nbins).select(
        F.col("id").cast("int").alias("bin"),
        (F.col("id") * width).cast("double").alias("bin_lo"),
    )
    return (
        F.broadcast(edges).join(counts, "bin", "left")
        .select("bin", "bin_lo", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    )


# ---------------------------------------------------------------- O-45
def pass_fail_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("passed") == 1).alias("n_pass"),
        F.count_if(F.col("passed") == 0).alias("n_fail"),
    )


# ---------------------------------------------------------------- O-46
def subgroup_vs_all(df: DataFrame, roles: Roles, mask: Column) -> DataFrame:
    """Subgroup and overall KPIs in one pass; subgroup values are NULL if empty."""
    m = F.coalesce(mask, F.lit(False))
    y = F.col(roles.target)
    aggs = [
        F.count_if(m).alias("n_sub"),
        F.avg(F.when(m, y)).alias("mean_target_sub"),
        F.avg(F.when(m, F.col("passed"))).alias("pass_rate_sub"),
        F.avg(y).alias("mean_target_all"),
        F.avg("passed").alias("pass_rate_all"),
        F.count(F.lit(1)).alias("n_all"),
    ]
    if roles.absences:
        aggs += [F.avg(F.when(m, F.col(roles.absences))).alias("mean_absences_sub"),
                 F.avg(roles.absences).alias("mean_absences_all")]
    return df.agg(*aggs)


# ---------------------------------------------------------------- O-49, O-61
def column_profile_numeric(df: DataFrame, cols=None, approx: bool = False,
                           method: str | None = None) -> DataFrame:
    """mean, median, std (0.0 for one value), min, max per numeric column, long
    form; columns that are entirely NULL are skipped."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not cols:
        raise ValueError("no numeric column")
    m = _method(method, approx)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        med = [] if m in _BY_FIELD else [quantiles(x, (0.5,), m == "approx")[0].alias("median")]
        aggs.append(F.struct(
            F.lit(c).alias("column"),
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            *med,
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ).alias(f"p{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(cols))])).alias("p"))
    long = long.select("p.*").filter(F.col("n") > 0)
    if m in _BY_FIELD:
        med = _BY_FIELD[m](df, cols, (0.5,)).select(F.col("field").alias("column"), F.col("q0").alias("median"))
        # both sides hold one row per column
        long = long.join(F.broadcast(med), "column").select("column", "n", "mean", "median", "std", "min", "max")
    return long


def column_profile_text(df: DataFrame, cols=None, top: int = 20) -> DataFrame:
    """Top-`top` values per text column (count desc, value asc) and the number of
    distinct values; NULLs are not counted as values."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        raise ValueError("no text column")
    # unpivot → (column, value) pairs; the group-by is combinable, so a hot value
    # is pre-counted on each map task
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*").filter(F.col("value").isNotNull())
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    # Spark keeps the first `top` of each map task before the shuffle (WindowGroupLimit)
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # distinct count per column is a combinable aggregate; one row per column
    nd = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return best.join(F.broadcast(nd), "column")


# ---------------------------------------------------------------- O-51
def defaults(df: DataFrame, roles: Roles, numeric=None, categorical=None) -> DataFrame:
    """Typical values: median of numeric columns, lowest mode of text columns (one row)."""
    numeric = [c for c in (numeric or roles.numeric_all) if c in df.columns]
    categorical = [c for c in (categorical or roles.categorical) if c in df.columns]
    md = modes(df, categorical)
    medians = column_medians(df, numeric)
    typical = [F.lit(medians[c]).cast("double").alias(c) for c in numeric]
    typical += [F.lit(md[c]).cast("string").alias(c) for c in categorical]
    return df.sparkSession.range(1).select(*typical)


# ---------------------------------------------------------------- O-55
def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
