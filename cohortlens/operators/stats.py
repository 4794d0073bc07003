"""Statistics (O-69 … O-77): correlations, Welch t, one-way ANOVA, simple OLS,
box summaries, kernel density, scatter, and the test battery.

Every statistic is a combinable aggregate (count/avg/var/covar/regr_*), so a
hot group is reduced on the map side; test statistics and p-values are column arithmetic
on the resulting one-row-per-test tables.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.bounded import bounded
from ..functions.pvalues import p_value_f, p_value_t
from .explore import group_profile


# ---------------------------------------------------------------- O-69
def pearson(a: str, b: str) -> Column:
    """Pearson r; NULL (not an error) when a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_long(df: DataFrame, cols) -> DataFrame:
    """Full matrix in long form (a, b, r), computed from one aggregate over the
    upper triangle and the diagonal, then mirrored."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = df.agg(*[pearson(cols[i], cols[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    entries = []
    for i, j in pairs:
        entries.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), F.col(f"r_{i}_{j}").alias("r")))
        if i != j:
            entries.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"), F.col(f"r_{i}_{j}").alias("r")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


# ---------------------------------------------------------------- O-70, O-62
def corr_with_target(df: DataFrame, cols, target: str) -> DataFrame:
    cols = [c for c in cols if c != target]
    wide = df.agg(*[pearson(c, target).alias(f"r{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("r")) for i, c in enumerate(cols)
    ])).alias("e")).select("e.*")


def corr_top(df: DataFrame, cols, target: str, k: int = 5) -> DataFrame:
    """Top-k positive and top-k negative correlations with the target (ties by name)."""
    r = corr_with_target(df, cols, target).filter(F.col("r").isNotNull())
    pos = r.filter(F.col("r") > 0).orderBy(F.col("r").desc(), "column_name").limit(k).withColumn("sign", F.lit("positive"))
    neg = r.filter(F.col("r") < 0).orderBy(F.col("r").asc(), "column_name").limit(k).withColumn("sign", F.lit("negative"))
    return pos.unionByName(neg)


def strongest(df: DataFrame, cols, target: str) -> DataFrame:
    """Strongest factor by |r| (ties by name) with its sign."""
    r = corr_with_target(df, cols, target).filter(F.col("r").isNotNull())
    return r.orderBy(F.abs("r").desc(), "column_name").limit(1)


# ---------------------------------------------------------------- O-71
def welch(df: DataFrame, group_col: str, value: str) -> DataFrame:
    """Welch two-sample t for exactly two groups (ascending order fixes the sign)."""
    groups = [r[0] for r in df.select(group_col).filter(F.col(group_col).isNotNull())
              .distinct().orderBy(group_col).limit(3).collect()]
    if len(groups) != 2:
        raise ValueError(f"{group_col} must have exactly 2 groups, has {len(groups)}")
    a, b = groups
    y = F.col(value)
    ga, gb = F.col(group_col) == a, F.col(group_col) == b
    row = df.agg(
        F.count(F.when(ga, y)).alias("n_a"), F.count(F.when(gb, y)).alias("n_b"),
        F.avg(F.when(ga, y)).alias("mean_a"), F.avg(F.when(gb, y)).alias("mean_b"),
        F.var_samp(F.when(ga, y)).alias("var_a"), F.var_samp(F.when(gb, y)).alias("var_b"),
    )
    se_a = F.try_divide(F.col("var_a"), F.col("n_a"))
    se_b = F.try_divide(F.col("var_b"), F.col("n_b"))
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se_a + se_b))
    dof = F.try_divide(F.pow(se_a + se_b, 2),
                       F.try_divide(F.pow(se_a, 2), F.col("n_a") - 1) + F.try_divide(F.pow(se_b, 2), F.col("n_b") - 1))
    return row.select(F.lit(group_col).alias("group_col"), F.lit(str(a)).alias("group_a"),
                      F.lit(str(b)).alias("group_b"), "n_a", "n_b", "mean_a", "mean_b", "var_a", "var_b",
                      t.alias("t"), dof.alias("df"))


# ---------------------------------------------------------------- O-72
def anova(df: DataFrame, group_col: str, value: str) -> DataFrame:
    """One-way ANOVA F from per-group n/mean/var (two combinable aggregates)."""
    g = (df.filter(F.col(group_col).isNotNull() & F.col(value).isNotNull())
         .groupBy(group_col).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")))
    s = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("m")).alias("s_nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s_nmm"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ssw"),
    )
    ssb = F.col("s_nmm") - F.col("s_nm") * F.col("s_nm") / F.col("n")
    f = F.try_divide(F.try_divide(ssb, F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
    return s.select(F.lit(group_col).alias("group_col"), "k", "n", ssb.alias("ssb"), "ssw", f.alias("f"),
                    (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def group_means(df: DataFrame, group_col: str, value: str) -> DataFrame:
    return df.groupBy(group_col).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


# ---------------------------------------------------------------- O-73, O-74
def _ols_aggs(x: str, y: str, sfx: str = ""):
    return [
        F.regr_count(y, x).alias(f"n{sfx}"), F.regr_slope(y, x).alias(f"slope{sfx}"),
        F.regr_intercept(y, x).alias(f"intercept{sfx}"), F.regr_r2(y, x).alias(f"r2{sfx}"),
        F.regr_sxx(y, x).alias(f"sxx{sfx}"), F.regr_syy(y, x).alias(f"syy{sfx}"),
    ]


def _ols_t():
    b = F.col("slope")
    resid = F.try_divide(F.col("syy") - b * b * F.col("sxx"), F.col("n") - 2)
    return F.try_divide(b, F.sqrt(F.try_divide(resid, F.col("sxx"))))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Simple OLS y ~ x: slope, intercept, R², slope t on n-2 degrees of freedom."""
    r = df.agg(*_ols_aggs(x, y))
    return r.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "slope", "intercept", "r2",
                    _ols_t().alias("t"), (F.col("n") - 2).alias("df"))


def ols_many(df: DataFrame, xs, y: str) -> DataFrame:
    """Several simple regressions y ~ x in one aggregate pass, one row per x."""
    aggs = []
    for i, x in enumerate(xs):
        aggs += _ols_aggs(x, y, f"_{i}")
    w = df.agg(*aggs)
    rows = []
    for i, x in enumerate(xs):
        rows.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), *[
            F.col(f"{k}_{i}").alias(k) for k in ("n", "slope", "intercept", "r2", "sxx", "syy")]))
    long = w.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.select("x", "y", "n", "slope", "intercept", "r2", _ols_t().alias("t"), (F.col("n") - 2).alias("df"))


def ols_by(df: DataFrame, x: str, y: str, by: Column, by_name: str = "subpop") -> DataFrame:
    r = df.groupBy(by.alias(by_name)).agg(*_ols_aggs(x, y))
    return r.select(by_name, F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "slope", "intercept", "r2",
                    _ols_t().alias("t"), (F.col("n") - 2).alias("df"))


# ---------------------------------------------------------------- O-75
def scatter(df: DataFrame, x: str, y: str, key: str):
    """Every point with both values, and the regression with its end points (one row).

    For x = y the points are still given, and the line's numbers are NULL.  An unknown
    column is an error."""
    unknown = [c for c in (x, y, key) if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = both.select(key, F.col(x).alias("x"), F.col(y).alias("y"))
    line = df.agg(*_ols_aggs(x, y), F.min(x).alias("x_min"), F.max(x).alias("x_max")).select(
        "n", "slope", "intercept", "r2", "x_min", "x_max",
        (F.col("intercept") + F.col("slope") * F.col("x_min")).alias("y_at_min"),
        (F.col("intercept") + F.col("slope") * F.col("x_max")).alias("y_at_max"),
    )
    if x == y:
        line = line.withColumns({c: F.lit(None).cast("double") for c in ("slope", "intercept", "r2", "y_at_min", "y_at_max")})
    return points, line


# ---------------------------------------------------------------- O-77
def box_summary(df: DataFrame, value: str, by: str, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """Quartiles and 1.5·IQR whiskers per group (quartile table joined back on
    the group key, as a broadcast when its size allows)."""
    q = group_profile(df, value, by, approx).select(by, "n", "q1", "median", "q3")
    q = q.withColumns({"lo_fence": F.col("q1") - factor * (F.col("q3") - F.col("q1")),
                       "hi_fence": F.col("q3") + factor * (F.col("q3") - F.col("q1"))})
    q = bounded(q)
    j = df.select(by, value).join(q.select(by, "lo_fence", "hi_fence"), by)
    v = F.col(value)
    w = j.groupBy(by).agg(
        F.min(F.when(v >= F.col("lo_fence"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("hi_fence"), v)).alias("whisker_hi"),
        F.count_if((v < F.col("lo_fence")) | (v > F.col("hi_fence"))).alias("n_outliers"),
    )
    return q.join(w, by).select(by, "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")


def kde(df: DataFrame, col: str, points: int = 50, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid: one aggregate holding one sum per
    grid point (combinable, exact; no data × grid product is materialised).
    Bandwidth: Scott's rule with the sample std unless given."""
    st = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("s"), F.min(col).alias("lo"),
                F.max(col).alias("hi")).first()
    n = st["n"]
    if not n:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = bandwidth or ((st["s"] or 0.0) * n ** (-1 / 5)) or 1.0
    lo, hi = st["lo"] - 3 * h, st["hi"] + 3 * h
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    x = F.col(col)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    sums = df.filter(x.isNotNull()).agg(*[
        F.sum(F.exp(-0.5 * F.pow((F.lit(g) - x) / h, 2))).alias(f"d{i}") for i, g in enumerate(grid)
    ])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("x"), (F.col(f"d{i}") * norm).alias("density")) for i, g in enumerate(grid)
    ])).alias("e")).select("e.*")


# ---------------------------------------------------------------- O-76
def test_battery(df: DataFrame, value: str, two_group=(), multi_group=(), regressors=()) -> DataFrame:
    """Welch tests, ANOVAs and OLS slopes in one long table with p-values, from one pass over `df`.

    Every row is unpivoted to one entry for each test, (test, factor, level, x), and added up to the mergeable moments of
    (test, factor, level); the statistics come from those.  A two-group factor with more or fewer groups is an error
    when the table is read.  An empty factor (all NULL) gives a row of NULLs only for the regressions."""
    entries = [F.struct(F.lit(t).alias("test"), F.lit(o).alias("o"), F.lit(c).alias("factor"), level.alias("level"), x.alias("x")) for o, (t, c, level, x) in enumerate(
        [("welch", g, F.col(g).cast("string"), F.col(g).cast("double") if isinstance(df.schema[g].dataType, NumericType) else F.lit(None).cast("double")) for g in two_group]
        + [("anova", g, F.col(g).cast("string"), F.lit(None).cast("double")) for g in multi_group]
        + [("ols", c, F.lit(None).cast("string"), F.col(c).cast("double")) for c in regressors])]
    if not entries:
        raise ValueError("no tests asked for")
    long = df.select(F.col(value).cast("double").alias("y"), F.explode(F.array(*entries)).alias("e")).select("y", "e.*")
    long = long.where((F.col("test") == "ols") | (F.col("level").isNotNull() & F.col("y").isNotNull()))
    moments = long.groupBy("test", "o", "factor", "level").agg(
        F.count("y").alias("n"), F.avg("y").alias("m"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("v"), F.var_samp("y").isNull().alias("lone"), F.min("x").alias("x"),
        F.regr_count("y", "x").alias("rn"), F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    # lowest and highest level are the two groups of a Welch test; an ANOVA needs sums over all levels only
    level = {name: (F.min_by(name, F.struct("x", "level")).alias(f"{name}_a"), F.max_by(name, F.struct("x", "level")).alias(f"{name}_b")) for name in ("n", "m", "v", "lone")}
    tests = moments.groupBy("test", "o", "factor").agg(
        F.count("level").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("within"), *[c for pair in level.values() for c in pair],
        F.max("rn").alias("rn"), F.max("slope").alias("slope"), F.max("sxx").alias("sxx"), F.max("syy").alias("syy"))

    two = F.when(F.col("k") == 2, F.lit(True)).otherwise(F.raise_error(F.concat(F.col("factor"), F.lit(" must have exactly 2 groups, has "), F.col("k").cast("string"))).cast("boolean"))
    se = [F.when(~F.col(f"lone_{g}"), F.col(f"v_{g}") / F.col(f"n_{g}")) for g in "ab"]
    t = F.when(two, F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(se[0] + se[1])))
    freedom = F.try_divide(F.pow(se[0] + se[1], 2), F.try_divide(F.pow(se[0], 2), F.col("n_a") - 1) + F.try_divide(F.pow(se[1], 2), F.col("n_b") - 1))
    between = F.col("nmm") - F.col("nm") * F.try_divide(F.col("nm"), F.col("n"))
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    rest = F.try_divide(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.col("rn") - 2)
    slope_t = F.try_divide(F.col("slope"), F.sqrt(F.try_divide(rest, F.col("sxx"))))
    test = F.col("test")
    stats = tests.select(
        "test", "factor", F.when(test == "welch", t).when(test == "anova", f).otherwise(slope_t).alias("statistic"),
        F.when(test == "welch", freedom).when(test == "anova", F.col("k") - 1).otherwise(F.col("rn") - 2).cast("double").alias("df1"),
        F.when(test == "anova", F.col("n") - F.col("k")).cast("double").alias("df2"))
    p = F.when(test == "anova", p_value_f(F.col("statistic"), F.col("df1"), F.col("df2"))).otherwise(p_value_t(F.col("statistic"), F.col("df1")))
    return stats.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)
