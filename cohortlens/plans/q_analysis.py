"""Registered jobs for ranks, statistics, alerts, insight and tracking."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import clean
from ..operators import insight as I
from ..operators import ranks as K
from ..operators import stats as S
from ..operators import tracking as TR
from ..roles import SUBJECTS as R
from ..roles import SUBJECTS_LOAD
from ..sources.tables import read
from .bindings import SNAPSHOTS_SQL, snapshots
from .curated import curated
from .oracle import with_curated
from .registry import register, rounded

PCT_COLS = ["g3", "effort", "absences"]


def _pct_sql(c):
    num = f"((RANK() OVER (ORDER BY {c}) - 1) * 2 + COUNT(*) OVER (PARTITION BY {c}) + 1) * 1000"
    den = "(2 * COUNT(*) OVER ())"
    q, r = f"({num} // {den})", f"({num} - ({num} // {den}) * {den})"
    return (f"(CASE WHEN 2 * {r} > {den} OR (2 * {r} = {den} AND {q} % 2 = 1) THEN {q} + 1 ELSE {q} END) / 10.0"
            f" AS pct_{c}")


@register("percentile_rank", with_curated(f"SELECT subject_id, {', '.join(_pct_sql(c) for c in PCT_COLS)} FROM curated"))
def q_pct_rank(spark, sf_dir):
    return K.percentile_rank(curated(spark, sf_dir), "subject_id", PCT_COLS)


@register("percentile_rank_lineitem",
          f"SELECT l_orderkey, l_linenumber, {_pct_sql('l_extendedprice')} FROM lineitem")
def q_pct_rank_li(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = K.percentile_rank(li.withColumn("__k", F.struct("l_orderkey", "l_linenumber")), "__k", ["l_extendedprice"])
    return out.select(F.col("__k.l_orderkey").alias("l_orderkey"), F.col("__k.l_linenumber").alias("l_linenumber"),
                      "pct_l_extendedprice")


ECDF = (("absences", 9.0), ("g3", 12.0), ("effort", 2.0))


@register("ecdf_value", with_curated("SELECT " + ", ".join(
    f"ROUND(AVG(CASE WHEN {c} <= {v} THEN 1.0 ELSE 0.0 END) * 100, 6) AS ecdf_{c}" for c, v in ECDF) + " FROM curated"))
def q_ecdf(spark, sf_dir):
    df = curated(spark, sf_dir)
    return rounded(df.agg(*[K.ecdf_at(df, c, v).alias(f"ecdf_{c}") for c, v in ECDF]))


_SNAP = f"WITH snaps AS ({SNAPSHOTS_SQL})\n"


@register("running_mae", _SNAP + """
, v AS (SELECT id, label, predicted, actual, recorded_at,
               ABS(CAST(ROUND(actual * 100) AS BIGINT) - CAST(ROUND(predicted * 100) AS BIGINT)) AS e FROM snaps
        WHERE actual IS NOT NULL),
r AS (SELECT *, SUM(e) OVER (ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING) AS s,
             COUNT(*) OVER (ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM v)
SELECT id, label, predicted, actual, recorded_at, e / 100.0 AS error,
       (CASE WHEN 2 * (s - (s // n_so_far) * n_so_far) > n_so_far
              OR (2 * (s - (s // n_so_far) * n_so_far) = n_so_far AND (s // n_so_far) % 2 = 1)
             THEN s // n_so_far + 1 ELSE s // n_so_far END) / 100.0 AS cumulative_mae,
       n_so_far FROM r""")
def q_running_mae(spark, sf_dir):
    return TR.accuracy_over_time(snapshots(spark, sf_dir))


@register("snapshot_status", _SNAP + """
SELECT id, (CAST(ROUND(actual * 100) AS BIGINT) - CAST(ROUND(predicted * 100) AS BIGINT)) / 100.0 AS diff,
       CASE WHEN actual IS NULL THEN 'pending'
            WHEN (CAST(ROUND(actual * 100) AS BIGINT) - CAST(ROUND(predicted * 100) AS BIGINT)) / 100.0 > 0.5 THEN 'better'
            WHEN (CAST(ROUND(actual * 100) AS BIGINT) - CAST(ROUND(predicted * 100) AS BIGINT)) / 100.0 < -0.5 THEN 'worse'
            ELSE 'as_predicted' END AS status FROM snaps""")
def q_snapshot_status(spark, sf_dir):
    return TR.snapshot_status(snapshots(spark, sf_dir)).select("id", "diff", "status")


@register("validation_summary", _SNAP + """
, v AS (SELECT ABS(CAST(ROUND(actual * 100) AS BIGINT) - CAST(ROUND(predicted * 100) AS BIGINT)) AS e,
               (CAST(ROUND(actual * 100) AS BIGINT) - CAST(ROUND(predicted * 100) AS BIGINT)) / 100.0 AS d
        FROM snaps WHERE actual IS NOT NULL),
a AS (SELECT COUNT(*) AS n, SUM(e) AS s, SUM(e * e) AS ss, COUNT(*) FILTER (WHERE d > 0.5) AS nb,
             COUNT(*) FILTER (WHERE d < -0.5) AS nw, COUNT(*) FILTER (WHERE d >= -0.5 AND d <= 0.5) AS np FROM v)
SELECT n AS n_validated,
       (CASE WHEN 2 * (s - (s // n) * n) > n OR (2 * (s - (s // n) * n) = n AND (s // n) % 2 = 1)
             THEN s // n + 1 ELSE s // n END) / 100.0 AS mae,
       ROUND(SQRT(ss / n) / 100.0, 2) AS rmse, nb AS n_better, nw AS n_worse, np AS n_as_predicted FROM a""")
def q_validation(spark, sf_dir):
    return TR.validation_summary(snapshots(spark, sf_dir))


@register("trend_projection", with_curated("""
, m AS (SELECT segment, COUNT(*) AS n, AVG(g1) AS mean_g1, AVG(g2) AS mean_g2, AVG(g3) AS mean_g3 FROM curated GROUP BY segment),
f AS (SELECT *, ((mean_g1 * 1.0 + mean_g2 * 2.0 + mean_g3 * 3.0) * 3.0 - (mean_g1 + mean_g2 + mean_g3) * 6.0) / 6.0 AS slope FROM m),
g AS (SELECT *, ((mean_g1 + mean_g2 + mean_g3) - slope * 6.0) / 3.0 AS intercept FROM f)
SELECT segment, n, ROUND(mean_g1, 6) AS mean_g1, ROUND(mean_g2, 6) AS mean_g2, ROUND(mean_g3, 6) AS mean_g3,
       ROUND(slope, 6) AS slope, ROUND(intercept, 6) AS intercept,
       ROUND(LEAST(GREATEST(intercept + slope * 4.0, 0.0), 20.0), 6) AS projected,
       CASE WHEN slope > 0.05 THEN 'improving' WHEN slope < -0.05 THEN 'worsening' ELSE 'stable' END AS direction
FROM g"""))
def q_trend(spark, sf_dir):
    return rounded(K.trend_projection(curated(spark, sf_dir), ["g1", "g2", "g3"], ["segment"]))


CORR_COLS = ["n_orders", "effort", "failures", "absences", "g1", "g2", "g3"]
LI_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(cols, table):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(COVAR_POP({a}, {b}) / "
                         f"NULLIF(STDDEV_POP({a}) * STDDEV_POP({b}), 0), 6) AS r FROM {table}")
    return " UNION ALL ".join(parts)


@register("corr_matrix", with_curated(_corr_sql(CORR_COLS, "curated")))
def q_corr(spark, sf_dir):
    return rounded(S.corr_long(curated(spark, sf_dir), CORR_COLS))


@register("corr_matrix_lineitem", _corr_sql(LI_CORR, "lineitem"))
def q_corr_li(spark, sf_dir):
    return rounded(S.corr_long(read(spark, sf_dir, "lineitem"), LI_CORR))


INPUTS = ["n_orders", "effort", "failures", "absences", "g1", "g2"]


@register("corr_top", with_curated(", r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COVAR_POP({c}, g3) / NULLIF(STDDEV_POP({c}) * STDDEV_POP(g3), 0) AS r FROM curated"
    for c in INPUTS) + """),
p AS (SELECT * FROM r WHERE r > 0 ORDER BY r DESC, column_name LIMIT 5),
q AS (SELECT * FROM r WHERE r < 0 ORDER BY r ASC, column_name LIMIT 5)
SELECT column_name, ROUND(r, 6) AS r, 'positive' AS sign FROM p UNION ALL
SELECT column_name, ROUND(r, 6) AS r, 'negative' AS sign FROM q"""))
def q_corr_top(spark, sf_dir):
    return rounded(S.corr_top(curated(spark, sf_dir), INPUTS, "g3"))


def _welch_sql(g, v, table):
    return f"""
, gr AS (SELECT {g} AS grp, COUNT({v}) AS n, AVG({v}) AS m, VAR_SAMP({v}) AS va FROM {table} WHERE {g} IS NOT NULL GROUP BY {g}),
a AS (SELECT * FROM gr ORDER BY grp LIMIT 1), b AS (SELECT * FROM gr ORDER BY grp DESC LIMIT 1)
SELECT '{g}' AS group_col, a.grp AS group_a, b.grp AS group_b, a.n AS n_a, b.n AS n_b, ROUND(a.m, 6) AS mean_a,
       ROUND(b.m, 6) AS mean_b, ROUND(a.va, 6) AS var_a, ROUND(b.va, 6) AS var_b,
       ROUND((a.m - b.m) / SQRT(a.va / a.n + b.va / b.n), 6) AS t,
       ROUND(POW(a.va / a.n + b.va / b.n, 2) / (POW(a.va / a.n, 2) / (a.n - 1) + POW(b.va / b.n, 2) / (b.n - 1)), 6) AS df
FROM a, b"""


@register("welch_stat", with_curated(_welch_sql("flag", "g3", "curated")))
def q_welch(spark, sf_dir):
    return rounded(S.welch(curated(spark, sf_dir), "flag", "g3"))


@register("welch_lineitem", "WITH x AS (SELECT 1)" + _welch_sql("l_linestatus", "l_extendedprice", "lineitem"))
def q_welch_li(spark, sf_dir):
    return rounded(S.welch(read(spark, sf_dir, "lineitem"), "l_linestatus", "l_extendedprice"))


def _anova_sql(g, v, table):
    return f"""
, gr AS (SELECT {g}, COUNT({v}) AS n, AVG({v}) AS m, VAR_SAMP({v}) AS va FROM {table}
         WHERE {g} IS NOT NULL AND {v} IS NOT NULL GROUP BY {g}),
s AS (SELECT COUNT(*) AS k, SUM(n) AS n, SUM(n * m) AS s_nm, SUM(n * m * m) AS s_nmm,
             SUM(COALESCE((n - 1) * va, 0.0)) AS ssw FROM gr)
SELECT '{g}' AS group_col, k, CAST(n AS BIGINT) AS n, ROUND(s_nmm - s_nm * s_nm / n, 6) AS ssb, ROUND(ssw, 6) AS ssw,
       ROUND(((s_nmm - s_nm * s_nm / n) / (k - 1)) / (ssw / (n - k)), 6) AS f,
       k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within FROM s"""


@register("anova_stat", with_curated(_anova_sql("effort", "g3", "curated")))
def q_anova(spark, sf_dir):
    return rounded(S.anova(curated(spark, sf_dir), "effort", "g3"))


@register("anova_lineitem", "WITH x AS (SELECT 1)" + _anova_sql("l_returnflag", "l_quantity", "lineitem"))
def q_anova_li(spark, sf_dir):
    return rounded(S.anova(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity"))


OLS_X = ["effort", "absences", "failures"]


def _ols_sql(x, y, table, by=None):
    sel = f"{by} AS subpop, " if by else ""
    grp = " GROUP BY 1" if by else ""
    return (f"SELECT {sel}'{x}' AS x, '{y}' AS y, CAST(REGR_COUNT({y}, {x}) AS BIGINT) AS n, "
            f"ROUND(REGR_SLOPE({y}, {x}), 6) AS slope, "
            f"ROUND(REGR_INTERCEPT({y}, {x}), 6) AS intercept, ROUND(REGR_R2({y}, {x}), 6) AS r2, "
            f"ROUND(REGR_SLOPE({y}, {x}) / SQRT(((REGR_SYY({y}, {x}) - REGR_SLOPE({y}, {x}) * REGR_SLOPE({y}, {x}) * "
            f"REGR_SXX({y}, {x})) / (REGR_COUNT({y}, {x}) - 2)) / REGR_SXX({y}, {x})), 6) AS t, "
            f"CAST(REGR_COUNT({y}, {x}) AS BIGINT) - 2 AS df FROM {table}{grp}")


@register("ols", with_curated(" UNION ALL ".join(_ols_sql(x, "g3", "curated") for x in OLS_X)))
def q_ols(spark, sf_dir):
    return rounded(S.ols_many(curated(spark, sf_dir), OLS_X, "g3"))


_SUBPOP = "CASE WHEN failures >= 1 THEN 'with_failures' ELSE 'no_failures' END"


@register("ols_by_subpop", with_curated(_ols_sql("effort", "g3", "curated", _SUBPOP)))
def q_ols_by(spark, sf_dir):
    sub = F.when(F.col("failures") >= 1, "with_failures").otherwise("no_failures")
    return rounded(S.ols_by(curated(spark, sf_dir), "effort", "g3", sub))


@register("box_summary", with_curated("""
, q AS (SELECT segment, COUNT(g3) AS n, quantile_cont(g3, 0.25) AS q1, quantile_cont(g3, 0.5) AS median,
               quantile_cont(g3, 0.75) AS q3 FROM curated GROUP BY segment),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
w AS (SELECT c.segment, MIN(CASE WHEN g3 >= lo THEN g3 END) AS whisker_lo, MAX(CASE WHEN g3 <= hi THEN g3 END) AS whisker_hi,
             COUNT(*) FILTER (WHERE g3 < lo OR g3 > hi) AS n_outliers FROM curated c JOIN f ON c.segment = f.segment
      GROUP BY c.segment)
SELECT f.segment, n, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, ROUND(whisker_lo, 6) AS whisker_lo,
       ROUND(whisker_hi, 6) AS whisker_hi, n_outliers FROM f JOIN w ON f.segment = w.segment"""))
def q_box(spark, sf_dir):
    return rounded(S.box_summary(curated(spark, sf_dir), "g3", "segment"))


def _kde_sql(col="g3", points=50):
    sums = ", ".join(
        f"SUM(EXP(-0.5 * POW(((lo + (hi - lo) * {i} / {points - 1}) - {col}) / h, 2))) AS d{i}" for i in range(points))
    rows = " UNION ALL ".join(
        f"SELECT ROUND(lo + (hi - lo) * {i} / {points - 1}, 6) AS x, ROUND(d{i} * norm, 6) AS density FROM s"
        for i in range(points))
    return f"""
, st AS (SELECT COUNT({col}) AS n, STDDEV_SAMP({col}) AS sd, MIN({col}) AS mn, MAX({col}) AS mx FROM curated),
b AS (SELECT n, sd * POW(n, -0.2) AS h, mn, mx FROM st),
g AS (SELECT n, h, mn - 3 * h AS lo, mx + 3 * h AS hi, 1.0 / (n * h * SQRT(2 * PI())) AS norm FROM b),
s AS (SELECT ANY_VALUE(lo) AS lo, ANY_VALUE(hi) AS hi, ANY_VALUE(norm) AS norm, {sums}
      FROM curated, g WHERE {col} IS NOT NULL)
{rows}"""


@register("kde", with_curated(_kde_sql()))
def q_kde(spark, sf_dir):
    return rounded(S.kde(curated(spark, sf_dir), "g3"))


_BATTERY_X = ("effort", "absences", "failures")
_BATTERY_SQL = """
, wg AS (SELECT flag AS g, COUNT(g3) AS n, AVG(g3) AS m, VAR_SAMP(g3) / COUNT(g3) AS se FROM curated WHERE flag IS NOT NULL GROUP BY flag),
""" + ", ".join(f"""g_{c} AS (SELECT {c} AS g, COUNT(g3) AS n, AVG(g3) AS m, COALESCE(VAR_SAMP(g3), 0) AS v FROM curated WHERE {c} IS NOT NULL AND g3 IS NOT NULL GROUP BY {c})""" for c in ("effort", "segment")) + """,
tests AS (
  SELECT 'welch' AS test, 'flag' AS factor, (a.m - b.m) / SQRT(a.se + b.se) AS statistic,
         POW(a.se + b.se, 2) / (POW(a.se, 2) / (a.n - 1) + POW(b.se, 2) / (b.n - 1)) AS df1, NULL AS df2 FROM wg a, wg b WHERE a.g < b.g
""" + "".join(f"""  UNION ALL SELECT 'anova', '{c}', ((SUM(n * m * m) - SUM(n * m) * SUM(n * m) / SUM(n)) / (COUNT(*) - 1)) / (SUM((n - 1) * v) / (SUM(n) - COUNT(*))),
         COUNT(*) - 1, SUM(n) - COUNT(*) FROM g_{c}
""" for c in ("effort", "segment")) + "".join(f"""  UNION ALL SELECT 'ols', '{c}', REGR_SLOPE(g3, {c}) / SQRT(((REGR_SYY(g3, {c}) - POW(REGR_SLOPE(g3, {c}), 2) * REGR_SXX(g3, {c})) / (REGR_COUNT(g3, {c}) - 2)) / REGR_SXX(g3, {c})),
         REGR_COUNT(g3, {c}) - 2, NULL FROM curated
""" for c in _BATTERY_X) + """),
par AS (SELECT *, CAST(CASE WHEN test = 'anova' THEN df2 / 2 ELSE df1 / 2 END AS DOUBLE) AS a0, CAST(CASE WHEN test = 'anova' THEN df1 / 2 ELSE 0.5 END AS DOUBLE) AS b0,
               CAST(CASE WHEN test = 'anova' THEN df2 / (df2 + df1 * statistic) ELSE df1 / (df1 + statistic * statistic) END AS DOUBLE) AS x0 FROM tests),
side AS (SELECT *, x0 < (a0 + 1) / (a0 + b0 + 2) AS low FROM par),
ready AS (SELECT *, CASE WHEN low THEN a0 ELSE b0 END AS a, CASE WHEN low THEN b0 ELSE a0 END AS b, CASE WHEN low THEN x0 ELSE 1 - x0 END AS x FROM side),
frac AS (
  SELECT test, factor, a, b, x, 0 AS i, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM ready
  UNION ALL
  SELECT test, factor, a, b, x, i + 1, 1 + odd / c1, 1 / (1 + odd * d1), h1 * (1 + odd / c1) / (1 + odd * d1)
  FROM (SELECT *, -(a + i + 1) * (a + b + i + 1) * x / ((a + 2 * i + 2) * (a + 2 * i + 3)) AS odd, 1 + even / c AS c1, 1 / (1 + even * d) AS d1, h * (1 + even / c) / (1 + even * d) AS h1
        FROM (SELECT *, (i + 1) * (b - i - 1) * x / ((a + 2 * i + 1) * (a + 2 * i + 2)) AS even FROM frac WHERE i < 1500))),
p AS (SELECT r.*, EXP(LGAMMA(r.a0 + r.b0) - LGAMMA(r.a0) - LGAMMA(r.b0) + r.a0 * LN(r.x0) + r.b0 * LN(1 - r.x0)) * f.h / r.a AS part
      FROM ready r JOIN frac f ON r.test = f.test AND r.factor = f.factor AND f.i = 1500)
SELECT test, factor, ROUND(statistic, 6) AS statistic, ROUND(CAST(df1 AS DOUBLE), 6) AS df1, ROUND(CAST(df2 AS DOUBLE), 6) AS df2,
       ROUND(CASE WHEN low THEN part ELSE 1 - part END, 6) AS p_value, CASE WHEN low THEN part ELSE 1 - part END < 0.05 AS significant FROM p"""


@register("pvalue_battery", with_curated(_BATTERY_SQL).replace("WITH subjects AS", "WITH RECURSIVE subjects AS", 1))
def q_battery(spark, sf_dir):
    return rounded(S.test_battery(curated(spark, sf_dir), "g3", two_group=["flag"], multi_group=["effort", "segment"],
                                  regressors=["effort", "absences", "failures"]))


_ALERTS_SQL = """
, st AS (SELECT AVG(absences) AS m, STDDEV_SAMP(absences) AS s, quantile_cont(absences, 0.5) AS med FROM curated),
c AS (SELECT AVG(at_risk) AS risk_rate, COUNT(*) FILTER (WHERE absences > st.m + 2 * st.s) AS n_high,
             COUNT(*) FILTER (WHERE failures >= 1 AND grade_trend < 0) AS n_wor,
             COUNT(*) FILTER (WHERE absences > st.med AND failures >= 1) AS n_comb, COUNT(*) AS n,
             ANY_VALUE(st.m + 2 * st.s) AS high, ANY_VALUE(st.med) AS med FROM curated, st),
r AS (SELECT 1 AS rule_no, 'risk_rate_high' AS rule_id, 'urgent' AS severity, CAST(ROUND(risk_rate * n) AS BIGINT) AS n,
             risk_rate AS value, risk_rate >= 0.3 AS fired FROM c
      UNION ALL SELECT 2, 'high_absences', 'warning', n_high, high, n_high > 0 FROM c
      UNION ALL SELECT 3, 'worsening_with_failures', 'warning', n_wor, NULL, n_wor > 0 FROM c
      UNION ALL SELECT 4, 'combined_risk', CASE WHEN n_comb / n >= 0.05 THEN 'urgent' ELSE 'warning' END, n_comb, med,
                       n_comb > 0 FROM c),
o AS (SELECT rule_no, rule_id, severity, n, value FROM r WHERE fired
      UNION ALL SELECT 99, 'all_clear', 'info', 0, NULL FROM (SELECT COUNT(*) FILTER (WHERE fired) AS k FROM r) WHERE k = 0)
SELECT rule_no, rule_id, severity, n, ROUND(value, 6) AS value,
       CASE severity WHEN 'urgent' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank FROM o"""


@register("alert_rules", with_curated(_ALERTS_SQL))
def q_alerts(spark, sf_dir):
    return rounded(A.alert_rules(curated(spark, sf_dir), R))


_LOAD_SQL = "(absences * 2.0 + failures * 1.0) / 3.0"


def _loaded(spark, sf_dir):
    """The curated table with its composite column."""
    return clean.derive_features(curated(spark, sf_dir), SUBJECTS_LOAD)


@register("alert_rules_heavy_use", with_curated(_ALERTS_SQL.replace(
    "),\no AS (", f"""
      UNION ALL SELECT 5, 'heavy_use_low_target', 'info', n_heavy, 3.0, n_heavy > 0
                FROM (SELECT COUNT(*) FILTER (WHERE {_LOAD_SQL} >= 3 AND g3 < {R.pass_mark}) AS n_heavy FROM curated)),\no AS (""", 1)))
def q_alerts_heavy(spark, sf_dir):
    """O-99 with the heavy-use rule on the composite column."""
    return rounded(A.alert_rules(_loaded(spark, sf_dir), SUBJECTS_LOAD, heavy_use="load"))


@register("combined_risk", with_curated("""
, st AS (SELECT quantile_cont(absences, 0.5) AS med FROM curated),
c AS (SELECT ANY_VALUE(st.med) AS med, COUNT(*) FILTER (WHERE absences > st.med AND failures >= 1) AS n_combined,
             COUNT(*) AS n, AVG(CASE WHEN absences > st.med AND failures >= 1 THEN g3 END) AS mc,
             AVG(CASE WHEN NOT (absences > st.med AND failures >= 1) THEN g3 END) AS mr FROM curated, st)
SELECT ROUND(med, 6) AS median_absences, n_combined, n, ROUND(n_combined / n, 6) AS share, ROUND(mc, 6) AS mean_combined,
       ROUND(mr, 6) AS mean_rest, ROUND(mr - mc, 6) AS gap,
       CASE WHEN n_combined / n >= 0.05 THEN 'urgent' ELSE 'warning' END AS severity FROM c WHERE n_combined > 0"""))
def q_combined(spark, sf_dir):
    return rounded(A.combined_risk(curated(spark, sf_dir), R))


UNUSUAL_FIELDS = ["effort", "absences", "failures", "g1", "g2"]


def _unusual_sql():
    parts = []
    for c in UNUSUAL_FIELDS:
        parts.append(f"""SELECT subject_id, '{c}' AS field, 'warning' AS severity,
            CASE WHEN ({c} - m_{c}) / s_{c} > 0 THEN 'much_higher' ELSE 'much_lower' END AS code,
            ROUND(({c} - m_{c}) / s_{c}, 6) AS z,
            ROUND((SELECT COUNT(*) FROM curated r WHERE r.{c} <= o.{c}) / n * 100, 6) AS percentile
            FROM curated o, st WHERE s_{c} > 0 AND ABS(({c} - m_{c}) / s_{c}) >= 2.5""")
    parts.append("""SELECT subject_id, 'g2', 'warning', CASE WHEN g2 - g1 > 0 THEN 'jump_up' ELSE 'jump_down' END,
            ROUND(g2 - g1, 6), NULL FROM curated WHERE ABS(g2 - g1) >= 8""")
    parts.append("""SELECT subject_id, 'failures', 'info', 'many_failures_high_grades', NULL, NULL FROM curated
            WHERE failures >= 3 AND (g1 >= 15 OR g2 >= 15)""")
    st = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in UNUSUAL_FIELDS)
    return f", st AS (SELECT COUNT(*) AS n, {st} FROM curated)\n" + " UNION ALL ".join(parts)


@register("unusual_values", with_curated(_unusual_sql()))
def q_unusual(spark, sf_dir):
    return rounded(A.unusual_values(curated(spark, sf_dir), R, UNUSUAL_FIELDS, "subject_id"))


RADAR = ["effort", "absences", "failures", "n_orders"]


@register("radar", with_curated(", a AS (SELECT COUNT(*) FILTER (WHERE m) AS n_sub, " + ", ".join(
    f"MIN({c}) AS lo{i}, MAX({c}) AS hi{i}, AVG(CASE WHEN m THEN {c} END) AS s{i}, AVG({c}) AS a{i}"
    for i, c in enumerate(RADAR)) + " FROM (SELECT *, COALESCE(segment = 'BUILDING', FALSE) AS m FROM curated))\n"
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS ord, CASE WHEN n_sub > 0 THEN (CASE WHEN hi{i} - lo{i} = 0 THEN 50.0 ELSE "
        f"round_even((s{i} - lo{i}) / (hi{i} - lo{i}) * 100, 1) END) ELSE 0.0 END AS subgroup_value, "
        f"CASE WHEN hi{i} - lo{i} = 0 THEN 50.0 ELSE round_even((a{i} - lo{i}) / (hi{i} - lo{i}) * 100, 1) END "
        f"AS overall_value, n_sub AS n_subgroup FROM a" for i, c in enumerate(RADAR))))
def q_radar(spark, sf_dir):
    return rounded(I.radar(curated(spark, sf_dir), RADAR, F.col("segment") == "BUILDING"))


@register("insight", with_curated("""
, lv AS (SELECT effort, AVG(g3) AS lm, COUNT(*) AS ln FROM curated GROUP BY effort),
ma AS (SELECT AVG(absences) AS mabs FROM curated),
j AS (SELECT c.subject_id, c.effort, c.g3, c.failures, c.absences, l.lm, l.ln, x.lm AS nm, x.ln AS nn
      FROM curated c LEFT JOIN lv l ON c.effort = l.effort LEFT JOIN lv x ON c.effort = x.effort - 1)
SELECT subject_id, ROUND(effort, 6) AS effort, ROUND(g3, 6) AS g3, ROUND(lm, 6) AS own_mean, ROUND(g3 - lm, 6) AS diff_own,
       CAST(g3 >= lm AS INT) AS above_own,
       ROUND(CASE WHEN ln >= 5 AND nn >= 5 AND nm - lm > 0 THEN nm END, 6) AS next_mean,
       ROUND(CASE WHEN ln >= 5 AND nn >= 5 AND nm - lm > 0 THEN nm - lm END, 6) AS next_gain,
       CAST(failures >= 1 AS INT) AS has_failures, CAST(absences > mabs AS INT) AS absences_above_mean
FROM j, ma"""))
def q_insight(spark, sf_dir):
    return rounded(I.insight(curated(spark, sf_dir), R))


_RECOMMEND_SQL = """
, ma AS (SELECT AVG(absences) AS mabs FROM curated),
sp AS (SELECT CASE WHEN failures >= 1 THEN 'with_failures' ELSE 'no_failures' END AS subpop,
              REGR_SLOPE(g3, effort) AS effort_slope FROM curated GROUP BY 1),
c AS (SELECT subject_id, CASE WHEN failures >= 1 THEN 'with_failures' ELSE 'no_failures' END AS subpop,
             list_filter([CASE WHEN effort < 3 THEN 'raise_effort' END, CASE WHEN failures > 0 THEN 'address_failures' END,
                          CASE WHEN absences > mabs THEN 'reduce_absences' END,
                          CASE WHEN flag = 'no' THEN 'get_access' END], lambda x: x IS NOT NULL) AS codes FROM curated, ma)
SELECT subject_id, c.subpop, array_to_string(codes, ',') AS codes, CAST(len(codes) AS INT) AS n_codes,
       ROUND(effort_slope, 6) AS effort_slope FROM c LEFT JOIN sp ON c.subpop = sp.subpop"""


@register("recommendations", with_curated(_RECOMMEND_SQL))
def q_recommend(spark, sf_dir):
    return rounded(I.recommendations(curated(spark, sf_dir), R, no_access=("flag", "no")))


@register("recommendations_heavy_use", with_curated(_RECOMMEND_SQL.replace(
    "CASE WHEN flag", f"CASE WHEN {_LOAD_SQL} > 2 THEN 'reduce_heavy_use' END,\n                          CASE WHEN flag", 1)))
def q_recommend_heavy(spark, sf_dir):
    """O-111 with the heavy-use rule on the composite column."""
    return rounded(I.recommendations(_loaded(spark, sf_dir), SUBJECTS_LOAD, no_access=("flag", "no"), heavy_use="load"))


OVERVIEW_INPUTS = ["n_orders", "effort", "failures", "absences"]


@register("overview_summary", with_curated(", r AS (" + " UNION ALL ".join(
    f"SELECT {i} AS o, '{c}' AS name, COVAR_POP({c}, g3) / NULLIF(STDDEV_POP({c}) * STDDEV_POP(g3), 0) AS r FROM curated"
    for i, c in enumerate(OVERVIEW_INPUTS)) + """),
b AS (SELECT * FROM r WHERE r IS NOT NULL ORDER BY ABS(r) DESC, o LIMIT 1),
k AS (SELECT COUNT(*) AS n, AVG(passed) * 100 AS pass_pct, AVG(g3) AS mean_target, AVG(at_risk) * 100 AS risk_pct FROM curated)
SELECT n, ROUND(pass_pct, 6) AS pass_pct, ROUND(mean_target, 6) AS mean_target, ROUND(risk_pct, 6) AS risk_pct,
       b.name AS strongest_factor, ROUND(b.r, 6) AS strongest_r,
       CASE WHEN b.r > 0 THEN 'positive' WHEN b.r < 0 THEN 'negative' END AS strongest_sign FROM k, b"""))
def q_overview(spark, sf_dir):
    return rounded(I.overview(curated(spark, sf_dir), R, OVERVIEW_INPUTS))


# ---------------------------------------------------------------- O-50
@register("target_block", with_curated("""
SELECT COUNT(g3) AS n, ROUND(AVG(g3), 6) AS mean_target, ROUND(AVG(passed), 6) AS pass_rate,
       COUNT(*) FILTER (WHERE passed = 1) AS n_pass, COUNT(*) FILTER (WHERE passed = 0) AS n_fail,
       GREATEST(3, LEAST(20, COUNT(DISTINCT g3))) AS n_bins FROM curated"""))
def q_target_block(spark, sf_dir):
    """Target summary of a table with a detected target: mean, pass rate, pass/fail, bin count."""
    from ..operators import explore as X
    df = curated(spark, sf_dir)
    nb = X.adaptive_bins(df, "g3")
    # both sides are single-row aggregates; they are combined in one aggregate instead of a join
    one = df.agg(F.count("g3").alias("n"), F.avg("g3").alias("mean_target"), F.avg("passed").alias("pass_rate"),
                 F.count_if(F.col("passed") == 1).alias("n_pass"), F.count_if(F.col("passed") == 0).alias("n_fail"))
    return rounded(one.withColumn("n_bins", F.lit(nb).cast("bigint")))


# ---------------------------------------------------------------- O-110, O-28
@register("report_batch", with_curated("""
, lv AS (SELECT effort, AVG(g3) AS lm, COUNT(*) AS ln FROM curated GROUP BY effort),
ma AS (SELECT AVG(absences) AS mabs FROM curated),
j AS (SELECT c.subject_id, c.g3, c.at_risk, c.failures, c.absences, l.lm, l.ln, x.lm AS nm, x.ln AS nn
      FROM curated c LEFT JOIN lv l ON c.effort = l.effort LEFT JOIN lv x ON c.effort = x.effort - 1)
SELECT subject_id, ROUND(g3, 6) AS g3, ROUND(lm, 6) AS own_mean, ROUND(g3 - lm, 6) AS diff_own,
       ROUND(CASE WHEN ln >= 5 AND nn >= 5 AND nm - lm > 0 THEN nm - lm END, 6) AS next_gain,
       CAST(failures >= 1 AS INT) AS has_failures, CAST(absences > mabs AS INT) AS absences_above_mean
FROM j, ma WHERE at_risk = 1 ORDER BY g3, subject_id LIMIT 200"""))
def q_report_batch(spark, sf_dir):
    """At-risk rows, lowest target first, limit 200, each with its insight record."""
    df = curated(spark, sf_dir)
    top = df.filter(F.col("at_risk") == 1).orderBy("g3", "subject_id").limit(200)
    return rounded(I.insight(df, R, top).select("subject_id", "g3", "own_mean", "diff_own", "next_gain", "has_failures",
                            "absences_above_mean"))


# ---------------------------------------------------------------- O-29
@register("lookup_batch", with_curated("""
SELECT DISTINCT o_custkey AS subject_id FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT subject_id FROM curated)"""))
def q_lookup_batch(spark, sf_dir):
    """Batch point lookup: keys requested by urgent orders that are not in the curated table."""
    from ..operators import explore as X
    req = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT") \
        .select(F.col("o_custkey").alias("subject_id")).distinct()
    _, missing = X.lookup_many(curated(spark, sf_dir), R, req)
    return missing


@register("lookup_found", with_curated("""
SELECT subject_id, segment, effort, ROUND(g3, 6) AS g3, at_risk FROM curated
WHERE subject_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""))
def q_lookup_found(spark, sf_dir):
    """Batch point lookup: the rows found for the keys of urgent orders."""
    from ..operators import explore as X
    req = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("subject_id")).distinct()
    found, _ = X.lookup_many(curated(spark, sf_dir), R, req)
    return rounded(found.select("subject_id", "segment", "effort", "g3", "at_risk"))


# ---------------------------------------------------------------- O-127
@register("habits_map", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k, "
          "CAST(len(json_keys(props)) AS INT) AS n_keys FROM events")
def q_habits_map(spark, sf_dir):
    """JSON text decoded to a MAP (the snapshot habits column) and read back."""
    s = snapshots(spark, sf_dir)
    return s.select("id", F.element_at("habits", F.lit("k")).alias("k"), F.size("habits").alias("n_keys"))
