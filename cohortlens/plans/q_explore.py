"""Registered exploration jobs (O-26 … O-51) on the curated table and on lineitem."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore as X
from ..roles import SUBJECTS as R
from ..sources.tables import read
from .curated import curated
from .oracle import with_curated
from .registry import register, rounded

PAGE, PAGE_SIZE = 2, 20
EXPLORER_COLS = ["subject_id", "segment", "effort", "absences", "failures", "g1", "g2", "g3", "perf_band", "at_risk"]


@register("explorer_page", with_curated(f"""
, f AS (SELECT *, ROW_NUMBER() OVER (ORDER BY subject_id) AS rn, COUNT(*) OVER () AS total
        FROM curated WHERE segment = 'BUILDING' AND at_risk = 1),
p AS (SELECT total, GREATEST(1, CAST(CEIL(total / {PAGE_SIZE}.0) AS BIGINT)) AS pages FROM f LIMIT 1),
q AS (SELECT total, pages, LEAST({PAGE}, pages) AS page FROM p)
SELECT {', '.join('ROUND(' + c + ', 6) AS ' + c if c in ('effort','absences','failures','g1','g2','g3') else c for c in EXPLORER_COLS)},
       q.total, q.pages, CAST(q.page AS BIGINT) AS page
FROM f, q WHERE rn > (q.page - 1) * {PAGE_SIZE} AND rn <= q.page * {PAGE_SIZE}
"""))
def q_explorer(spark, sf_dir):
    df = curated(spark, sf_dir)
    total, pages, page, rows = X.explorer_page(df, R, {"segment": "BUILDING", "at_risk": 1}, PAGE, PAGE_SIZE)
    return rounded(rows.select(*EXPLORER_COLS).withColumns({
        "total": F.lit(total).cast("bigint"), "pages": F.lit(pages).cast("bigint"),
        "page": F.lit(page).cast("bigint")}))


AT_RISK_COLS = ["subject_id", "segment", "flag", "effort", "absences", "failures", "g3", "at_risk"]


@register("at_risk_top", with_curated(
    f"SELECT {', '.join(AT_RISK_COLS)} FROM curated WHERE at_risk = 1 ORDER BY g3, subject_id LIMIT 50"))
def q_at_risk(spark, sf_dir):
    return rounded(X.at_risk_top(curated(spark, sf_dir), R, 50, AT_RISK_COLS))


@register("kpis", with_curated("""SELECT COUNT(*) AS n, ROUND(AVG(g3), 6) AS mean_target,
    ROUND(AVG(passed), 6) AS pass_rate, ROUND(AVG(effort), 6) AS mean_effort,
    ROUND(AVG(absences), 6) AS mean_absences FROM curated"""))
def q_kpis(spark, sf_dir):
    return rounded(X.kpis(curated(spark, sf_dir), R))


@register("class_kpis", with_curated("""SELECT COUNT(*) AS n, ROUND(AVG(g3), 6) AS mean_target,
    ROUND(AVG(passed), 6) AS pass_rate, CAST(SUM(at_risk) AS BIGINT) AS n_at_risk,
    ROUND(AVG(failures), 6) AS mean_failures, ROUND(AVG(absences), 6) AS mean_absences FROM curated"""))
def q_class_kpis(spark, sf_dir):
    return rounded(X.class_kpis(curated(spark, sf_dir), R))


@register("rate_by_level", with_curated("""SELECT effort, COUNT(*) AS n, ROUND(AVG(passed), 6) AS pass_rate,
    ROUND(AVG(g3), 6) AS mean_target FROM curated GROUP BY effort"""))
def q_rate_by_level(spark, sf_dir):
    return rounded(X.rate_by_level(curated(spark, sf_dir), R))


@register("mean_by_category", with_curated(
    "SELECT flag, ROUND(AVG(g3), 6) AS mean_target FROM curated GROUP BY flag"))
def q_mean_by_cat(spark, sf_dir):
    return rounded(X.mean_by_category(curated(spark, sf_dir), R, "flag"))


_GP_SQL = """SELECT {by}, ROUND(AVG({v}), 6) AS mean, COUNT({v}) AS n,
    ROUND(quantile_cont({v}, 0.25), 6) AS q1, ROUND(quantile_cont({v}, 0.5), 6) AS median,
    ROUND(quantile_cont({v}, 0.75), 6) AS q3 FROM {t} GROUP BY {by}"""


@register("group_profile", with_curated(_GP_SQL.format(by="segment", v="g3", t="curated")))
def q_group_profile(spark, sf_dir):
    return rounded(X.group_profile(curated(spark, sf_dir), "g3", "segment"))


@register("group_profile_lineitem", _GP_SQL.format(by="l_returnflag", v="l_extendedprice", t="lineitem"))
def q_group_profile_li(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    # prices are continuous: exact quartiles without a per-group value map
    return rounded(X.group_profile(li, "l_extendedprice", "l_returnflag", method="prefix"))


@register("banded_mean", with_curated("""SELECT CAST(band AS INT) AS band, CAST(band_lo AS DOUBLE) AS band_lo,
    CAST(band_hi AS DOUBLE) AS band_hi,
    ROUND(AVG(g3), 6) AS mean_target, COUNT(*) AS n FROM (
      SELECT g3, CASE WHEN effort > 0.0 AND effort <= 1.5 THEN 0 WHEN effort > 1.5 AND effort <= 3.0 THEN 1
                      WHEN effort > 3.0 AND effort <= 5.0 THEN 2 END AS band,
                 CASE WHEN effort > 0.0 AND effort <= 1.5 THEN 0.0 WHEN effort > 1.5 AND effort <= 3.0 THEN 1.5
                      WHEN effort > 3.0 AND effort <= 5.0 THEN 3.0 END AS band_lo,
                 CASE WHEN effort > 0.0 AND effort <= 1.5 THEN 1.5 WHEN effort > 1.5 AND effort <= 3.0 THEN 3.0
                      WHEN effort > 3.0 AND effort <= 5.0 THEN 5.0 END AS band_hi
      FROM curated) WHERE band IS NOT NULL GROUP BY band, band_lo, band_hi"""))
def q_banded(spark, sf_dir):
    return rounded(X.banded_mean(curated(spark, sf_dir), R, "effort"))


def _hist_sql(col: str, table: str, bins_sql: str) -> str:
    return f"""
, mm AS (SELECT MIN({col}) AS lo, MAX({col}) AS hi, {bins_sql} AS nb FROM {table}),
b AS (SELECT CAST(LEAST(nb, GREATEST(1, CEIL(({col} - lo) / ((hi - lo) / nb)))) AS INT) AS bin
      FROM {table}, mm WHERE {col} IS NOT NULL),
c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin),
e AS (SELECT CAST(i AS INT) AS bin,
             CASE WHEN i = 1 THEN lo - (hi - lo) * 0.001 ELSE lo + (hi - lo) * (i - 1) / nb END AS bin_lo,
             lo + (hi - lo) * i / nb AS bin_hi
      FROM mm, range(1, 21) t(i) WHERE i <= nb)
SELECT e.bin, ROUND(bin_lo, 6) AS bin_lo, ROUND(bin_hi, 6) AS bin_hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM e LEFT JOIN c ON e.bin = c.bin"""


@register("histogram20", with_curated(_hist_sql("g3", "curated", "20")))
def q_hist20(spark, sf_dir):
    return rounded(X.histogram(curated(spark, sf_dir), "g3", 20))


@register("histogram20_lineitem", "WITH x AS (SELECT 1)" + _hist_sql("l_extendedprice", "lineitem", "20"))
def q_hist20_li(spark, sf_dir):
    return rounded(X.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 20))


@register("histogram_adaptive", with_curated(_hist_sql(
    "absences", "curated", "GREATEST(3, LEAST(20, (SELECT COUNT(DISTINCT absences) FROM curated)))")))
def q_hist_adaptive(spark, sf_dir):
    return rounded(X.histogram_adaptive(curated(spark, sf_dir), "absences"))


@register("target_histogram", with_curated(_hist_sql(
    "g3", "curated", "GREATEST(3, LEAST(20, (SELECT COUNT(DISTINCT g3) FROM curated)))")))
def q_target_hist(spark, sf_dir):
    """O-50: the histogram of the target block, in its number of bins."""
    return rounded(X.histogram_adaptive(curated(spark, sf_dir), "g3"))


@register("histogram_fixed", with_curated("""
, c AS (SELECT CAST(LEAST(10, FLOOR(g3 / 2.0)) AS INT) AS bin, COUNT(*) AS n FROM curated WHERE g3 IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INT) AS bin, CAST(i * 2.0 AS DOUBLE) AS bin_lo, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM range(0, 11) t(i) LEFT JOIN c ON c.bin = t.i"""))
def q_hist_fixed(spark, sf_dir):
    return rounded(X.histogram_fixed(curated(spark, sf_dir), "g3"))


@register("pass_fail_counts", with_curated(
    "SELECT COUNT(*) FILTER (WHERE passed = 1) AS n_pass, COUNT(*) FILTER (WHERE passed = 0) AS n_fail FROM curated"))
def q_pass_fail(spark, sf_dir):
    return X.pass_fail_counts(curated(spark, sf_dir))


@register("subgroup_vs_all", with_curated("""
SELECT COUNT(*) FILTER (WHERE m) AS n_sub, ROUND(AVG(CASE WHEN m THEN g3 END), 6) AS mean_target_sub,
       ROUND(AVG(CASE WHEN m THEN passed END), 6) AS pass_rate_sub, ROUND(AVG(g3), 6) AS mean_target_all,
       ROUND(AVG(passed), 6) AS pass_rate_all, COUNT(*) AS n_all,
       ROUND(AVG(CASE WHEN m THEN absences END), 6) AS mean_absences_sub, ROUND(AVG(absences), 6) AS mean_absences_all
FROM (SELECT *, COALESCE(effort BETWEEN 2 AND 4 AND flag = 'yes', FALSE) AS m FROM curated)"""))
def q_subgroup(spark, sf_dir):
    mask = X.subgroup_mask(R, level_min=2, level_max=4, equals={"flag": "yes"})
    return rounded(X.subgroup_vs_all(curated(spark, sf_dir), R, mask))


PROFILE_NUM = ["n_orders", "effort", "failures", "absences", "g1", "g2", "g3"]


def _profile_num_sql(cols, table):
    parts = [
        f"SELECT '{c}' AS column_name, COUNT({c}) AS n, ROUND(AVG({c}), 6) AS mean, "
        f"ROUND(quantile_cont({c}, 0.5), 6) AS median, ROUND(COALESCE(STDDEV_SAMP({c}), 0.0), 6) AS std, "
        f"ROUND(CAST(MIN({c}) AS DOUBLE), 6) AS min, ROUND(CAST(MAX({c}) AS DOUBLE), 6) AS max FROM {table}"
        for c in cols
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@register("column_profile_num", with_curated(", z AS (SELECT 1) " + _profile_num_sql(PROFILE_NUM, "curated")))
def q_profile_num(spark, sf_dir):
    return rounded(X.column_profile_numeric(curated(spark, sf_dir), PROFILE_NUM).withColumnRenamed("column", "column_name"))


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("column_profile_lineitem", _profile_num_sql(LI_NUM, "lineitem"))
def q_profile_li(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    # l_extendedprice is continuous: exact medians without a per-column value map
    return rounded(X.column_profile_numeric(li, LI_NUM, method="prefix").withColumnRenamed("column", "column_name"))


PROFILE_TXT = ["segment", "flag", "perf_band", "progress_badge"]


def _profile_txt_sql(cols, table):
    pairs = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {table}" for c in cols)
    return f"""
, pairs AS ({pairs}),
counts AS (SELECT column_name, value, COUNT(*) AS n FROM pairs WHERE value IS NOT NULL GROUP BY column_name, value),
r AS (SELECT column_name, value, n, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank,
             COUNT(*) OVER (PARTITION BY column_name) AS n_distinct FROM counts)
SELECT * FROM r WHERE rank <= 20"""


@register("column_profile_cat", with_curated(_profile_txt_sql(PROFILE_TXT, "curated")))
def q_profile_cat(spark, sf_dir):
    p = X.column_profile_text(curated(spark, sf_dir), PROFILE_TXT)
    return p.select(F.col("column").alias("column_name"), "value", F.col("count").alias("n"),
                    F.col("rank").cast("bigint").alias("rank"), "n_distinct")


@register("column_profile_cat_lineitem", "WITH x AS (SELECT 1)" + _profile_txt_sql(
    ["l_returnflag", "l_linestatus", "l_shipdate"], "lineitem"))
def q_profile_cat_li(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"))
    p = X.column_profile_text(li, ["l_returnflag", "l_linestatus", "l_shipdate"])
    return p.select(F.col("column").alias("column_name"), "value", F.col("count").alias("n"),
                    F.col("rank").cast("bigint").alias("rank"), "n_distinct")


DEFAULT_NUM = list(R.numeric_all)


@register("defaults", with_curated("SELECT " + ", ".join(
    [f"ROUND(quantile_cont({c}, 0.5), 6) AS {c}" for c in DEFAULT_NUM]
    + [f"(SELECT {c} FROM curated GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS {c}" for c in R.categorical]
) + " FROM curated"))
def q_defaults(spark, sf_dir):
    return rounded(X.defaults(curated(spark, sf_dir), R))
