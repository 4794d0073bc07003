"""Registered jobs for scoring-driven operators, models, kNN and segmentation."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ..functions.bounded import bounded
from ..functions.topk import modes
from ..operators import clean
from ..operators import foldsums as FS
from ..operators import models as M
from ..operators import segment as SG
from ..operators import suggest as SU
from ..operators import whatif as W
from ..operators.fill import ExactFill
from ..operators.ranks import exact_quantiles
from ..roles import SUBJECTS as R
from ..roles import SUBJECTS_LOAD
from ..sources.intake import segment_members
from ..session import scratch_path
from ..sources.tables import read
from .bindings import subjects
from .curated import curated
from .oracle import with_curated
from .registry import ORACLE, register, rounded

HABITS = ("effort", "absences")
PERIODS = ("g1", "g2")


def _scorer(df, inputs=HABITS):
    return W.LinearScorer.fit(df, inputs, "g3")


def _medians(df, cols):
    return {r["field"]: r["q0"] for r in exact_quantiles(df, cols, [0.5]).collect()}


def _coef_sql(x1, x2, name):
    return f"""
, st_{name} AS (SELECT COVAR_SAMP({x1}, {x1}) s11, COVAR_SAMP({x1}, {x2}) s12, COVAR_SAMP({x2}, {x2}) s22,
        COVAR_SAMP({x1}, g3) s1y, COVAR_SAMP({x2}, g3) s2y, AVG({x1}) m1, AVG({x2}) m2, AVG(g3) my FROM curated),
bu_{name} AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS u1,
                     (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS u2, m1, m2, my FROM st_{name}),
{name} AS (SELECT CAST(ROUND(my - (u1 * m1 + u2 * m2), 6) AS DECIMAL(18,6)) AS b0,
               CAST(ROUND(u1, 6) AS DECIMAL(18,6)) AS b1, CAST(ROUND(u2, 6) AS DECIMAL(18,6)) AS b2 FROM bu_{name})"""


def _pred_sql(m, x1, x2):
    return (f"CAST(round_even(LEAST(GREATEST({m}.b0 + {m}.b1 * CAST({x1} AS DECIMAL(18,6)) + {m}.b2 * "
            f"CAST({x2} AS DECIMAL(18,6)), 0.0), 20.0), 2) AS DOUBLE)")


_HAB = _coef_sql("effort", "absences", "hab")
_EFF_AFTER = "LEAST(GREATEST(effort + 1.0, 1.0), 4.0)"
_ABS_AFTER = "LEAST(GREATEST(absences + -2.0, 0.0), 93.0)"


@register("what_if_cohort", with_curated(_HAB + f"""
, s AS (SELECT {_pred_sql('hab', 'effort', 'absences')} AS before,
               {_pred_sql('hab', _EFF_AFTER, _ABS_AFTER)} AS after FROM curated, hab WHERE at_risk = 1)
SELECT COUNT(*) AS n_students, COUNT(*) FILTER (WHERE before >= 10) AS n_passing_before,
       COUNT(*) FILTER (WHERE after >= 10) AS n_passing_after,
       COUNT(*) FILTER (WHERE before < 10 AND after >= 10) AS newly_passing,
       ROUND(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE before >= 10) / COUNT(*) ELSE 0.0 END, 6) AS pass_rate_before,
       ROUND(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE after >= 10) / COUNT(*) ELSE 0.0 END, 6) AS pass_rate_after,
       ROUND(COALESCE(AVG(before), 0.0), 6) AS avg_grade_before, ROUND(COALESCE(AVG(after), 0.0), 6) AS avg_grade_after
FROM s"""))
def q_what_if(spark, sf_dir):
    df = curated(spark, sf_dir)
    return rounded(W.what_if_cohort(df, R, _scorer(df), {"effort": 1, "absences": -2}))


@register("quick_wins", with_curated(_HAB + f"""
, b AS (SELECT subject_id, effort, absences, {_pred_sql('hab', 'effort', 'absences')} AS base,
               {_pred_sql('hab', 'effort + 1.0', 'absences')} AS p_eff,
               {_pred_sql('hab', 'effort', 'absences - 1.0')} AS p_abs FROM curated, hab),
c AS (SELECT subject_id, 'effort' AS lever, 0 AS lever_no, effort AS from_value, effort + 1.0 AS to_value,
             CAST(CAST(p_eff AS DECIMAL(18,6)) - CAST(base AS DECIMAL(18,6)) AS DOUBLE) AS gain FROM b WHERE effort < 4
      UNION ALL
      SELECT subject_id, 'absences', 1, absences, absences - 1.0,
             CAST(CAST(p_abs AS DECIMAL(18,6)) - CAST(base AS DECIMAL(18,6)) AS DOUBLE) FROM b WHERE absences > 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY gain DESC, lever_no) AS rank FROM c WHERE gain > 0)
SELECT subject_id, CAST(rank AS INT) AS rank, lever, ROUND(from_value, 6) AS from_value, ROUND(to_value, 6) AS to_value,
       ROUND(gain, 6) AS gain FROM r WHERE rank <= 5"""))
def q_quick_wins(spark, sf_dir):
    df = curated(spark, sf_dir)
    return rounded(W.quick_wins(df, R, _scorer(df), "subject_id"))


@register("explain", with_curated(_HAB + f"""
, t AS (SELECT quantile_cont(effort, 0.5) AS te, quantile_cont(absences, 0.5) AS ta FROM curated),
b AS (SELECT subject_id, effort, absences, te, ta, {_pred_sql('hab', 'effort', 'absences')} AS base,
             {_pred_sql('hab', 'te', 'absences')} AS cf_e, {_pred_sql('hab', 'effort', 'ta')} AS cf_a FROM curated, hab, t),
c AS (SELECT subject_id, base, 'effort' AS factor, 0 AS o, effort AS value, te AS typical,
             CAST(CAST(base AS DECIMAL(18,6)) - CAST(cf_e AS DECIMAL(18,6)) AS DOUBLE) AS impact FROM b
      UNION ALL
      SELECT subject_id, base, 'absences', 1, absences, ta,
             CAST(CAST(base AS DECIMAL(18,6)) - CAST(cf_a AS DECIMAL(18,6)) AS DOUBLE) FROM b),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY ABS(impact) DESC, o) AS rank FROM c
      WHERE value <> typical AND ABS(impact) >= 0.05)
SELECT subject_id, ROUND(base, 6) AS base, CAST(rank AS INT) AS rank, factor, ROUND(value, 6) AS value,
       ROUND(typical, 6) AS typical, ROUND(impact, 6) AS impact FROM r"""))
def q_explain(spark, sf_dir):
    df = curated(spark, sf_dir)
    return rounded(W.explain(df, _scorer(df), "subject_id", _medians(df, HABITS)))


@register("residual_outliers", with_curated(_coef_sql("g1", "g2", "fullm") + f"""
, s AS (SELECT subject_id, g3, {_pred_sql("fullm", "g1", "g2")} AS pred FROM curated, fullm),
z AS (SELECT *, g3 - pred AS residual FROM s),
m AS (SELECT AVG(residual) AS m, STDDEV_POP(residual) AS sd FROM z),
o AS (SELECT subject_id, g3, pred, residual, (residual - m) / sd AS z FROM z, m WHERE sd > 0)
SELECT subject_id, ROUND(g3, 6) AS g3, ROUND(pred, 6) AS pred, ROUND(residual, 6) AS residual, ROUND(z, 6) AS z,
       CASE WHEN residual > 0 THEN 'above' ELSE 'below' END AS direction
FROM o WHERE ABS(z) >= 2.0 ORDER BY ABS(z) DESC, subject_id LIMIT 20"""))
def q_residuals(spark, sf_dir):
    df = curated(spark, sf_dir)
    return rounded(W.residual_outliers(df, _scorer(df, PERIODS), "subject_id", "g3"))


_D = "DECIMAL(18,6)"
_PLAN_SQL = _HAB + f"""
, b AS (SELECT subject_id, effort AS e0, absences AS a0, failures FROM curated),
plan AS (
  SELECT subject_id, 0 AS n, e0 AS e, a0 AS a, CAST({_pred_sql('hab', 'e0', 'a0')} AS {_D}) AS p FROM b, hab
  UNION ALL
  SELECT subject_id, n + 1, CASE WHEN k = 0 THEN e + 1.0 ELSE e END, CASE WHEN k = 1 THEN a + -1.0 ELSE a END,
         CAST(p + CASE WHEN k = 0 THEN ge ELSE ga END AS {_D})
  FROM (SELECT *, CASE WHEN ge > 0 AND (ga IS NULL OR ga <= 0 OR ge >= ga) THEN 0 WHEN ga > 0 THEN 1 END AS k
        FROM (SELECT subject_id, n, e, a, p,
                     CASE WHEN e < 4.0 THEN CAST({_pred_sql('hab', 'e + 1.0', 'a')} AS {_D}) - p END AS ge,
                     CASE WHEN a > 0.0 THEN CAST({_pred_sql('hab', 'e', 'a + -1.0')} AS {_D}) - p END AS ga
              FROM plan, hab WHERE p < 12.0 AND n < 80))
  WHERE k IS NOT NULL),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY n DESC) AS rn FROM plan)
SELECT l.subject_id, ROUND(CAST(p AS DOUBLE), 6) AS final_pred, CAST(n AS INT) AS steps, p >= 12.0 AS reached,
       ROUND(e, 6) AS effort_final, ROUND(e - e0, 6) AS effort_change, ROUND(a, 6) AS absences_final,
       ROUND(a - a0, 6) AS absences_change, CAST(failures >= 1 AND e > e0 AS INT) AS effort_with_failures_flag
FROM last l JOIN b ON l.subject_id = b.subject_id WHERE rn = 1"""


@register("greedy_plan", with_curated(_PLAN_SQL).replace("WITH subjects AS", "WITH RECURSIVE subjects AS", 1))
def q_plan(spark, sf_dir):
    """O-80 for every row (target 12): one row-wise expression; the oracle is a recursive CTE."""
    df = curated(spark, sf_dir)
    return rounded(W.greedy_plan(df, R, _scorer(df), "subject_id", 12.0).drop("changes"))


# steps of one lever in a row are one island: the step number less the number among the lever's steps is the same
_STEPS_SQL = _PLAN_SQL[:_PLAN_SQL.index("last AS (")] + """
moves AS (SELECT subject_id, n, e, a, LAG(e) OVER w AS e1, LAG(a) OVER w AS a1 FROM plan WINDOW w AS (PARTITION BY subject_id ORDER BY n)),
one AS (SELECT subject_id, n, CASE WHEN e > e1 THEN 'effort' ELSE 'absences' END AS lever, CASE WHEN e > e1 THEN e1 ELSE a1 END AS x, CASE WHEN e > e1 THEN e ELSE a END AS y
        FROM moves WHERE n > 0),
isl AS (SELECT *, n - ROW_NUMBER() OVER (PARTITION BY subject_id, lever ORDER BY n) AS g FROM one),
merged AS (SELECT subject_id, lever, MIN(n) AS n, arg_min(x, n) AS x, arg_max(y, n) AS y FROM isl GROUP BY subject_id, lever, g),
listed AS (SELECT subject_id, string_agg(lever || ':' || CAST(CAST(x AS DOUBLE) AS VARCHAR) || '->' || CAST(CAST(y AS DOUBLE) AS VARCHAR), ',' ORDER BY n) AS changes, COUNT(*) AS n_changes FROM merged GROUP BY subject_id),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY n DESC) AS rn FROM plan)
SELECT l.subject_id, ROUND(CAST(p AS DOUBLE), 6) AS final_pred, CAST(n AS INT) AS steps, p >= 12.0 AS reached, COALESCE(changes, '') AS changes,
       CAST(COALESCE(n_changes, 0) AS INT) AS n_changes FROM last l LEFT JOIN listed s ON s.subject_id = l.subject_id WHERE rn = 1"""
_STEPS_SQL = with_curated(_STEPS_SQL).replace("WITH subjects AS", "WITH RECURSIVE subjects AS", 1)


def _steps(plan):
    text = F.transform("changes", lambda s: F.concat_ws("", s["lever"], F.lit(":"), s["from_value"].cast("string"), F.lit("->"), s["to_value"].cast("string")))
    return rounded(plan.select("subject_id", "final_pred", "steps", "reached", F.array_join(text, ",").alias("changes"), F.size("changes").alias("n_changes")))


@register("greedy_plan_steps", _STEPS_SQL)
def q_plan_steps(spark, sf_dir):
    """O-80: the steps of every plan in order, those of one lever in a row merged."""
    df = curated(spark, sf_dir)
    return _steps(W.greedy_plan(df, R, _scorer(df), "subject_id", 12.0))


@register("greedy_plan_scored", _STEPS_SQL)
def q_plan_scored(spark, sf_dir):
    """O-80 by rounds over the frontier, as a trained model needs it; here with the linear scorer."""
    df = curated(spark, sf_dir)
    return _steps(W.greedy_plan_scored(df, R, _scorer(df), "subject_id", 12.0))


@register("quick_wins_scored", ORACLE["quick_wins"])
def q_quick_wins_scored(spark, sf_dir):
    """O-81 by scoring all candidates as rows; here with the linear scorer."""
    df = curated(spark, sf_dir)
    return rounded(W.quick_wins_scored(df, R, _scorer(df), "subject_id"))


@register("explain_scored", ORACLE["explain"])
def q_explain_scored(spark, sf_dir):
    """O-83 by scoring all candidates as rows; here with the linear scorer."""
    df = curated(spark, sf_dir)
    out = W.explain_scored(df, _scorer(df), "subject_id", _medians(df, HABITS))
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in ("value", "typical")}))


def _forest(df, trees=20):
    from pyspark.ml.regression import RandomForestRegressor
    model = Pipeline(stages=M.preprocessor(NUMERIC_HABITS, CATS) + [RandomForestRegressor(labelCol="g3", numTrees=trees, maxDepth=6, seed=M.SEED)]).fit(df)
    return W.ModelScorer(model, (*NUMERIC_HABITS, *CATS))


@register("quick_wins_forest")
def q_quick_wins_forest(spark, sf_dir):
    """O-81 with a trained forest, which no SQL expresses; tests hold it against single predictions."""
    df = curated(spark, sf_dir)
    return rounded(W.quick_wins_scored(df, R, _forest(df), "subject_id"))


@register("explain_forest")
def q_explain_forest(spark, sf_dir):
    """O-83 with a trained forest, text factors included."""
    df = curated(spark, sf_dir)
    typical = {**_medians(df, NUMERIC_HABITS), **modes(df, CATS)}
    return rounded(W.explain_scored(df, _forest(df), "subject_id", typical))


KNN_NUM = ["effort", "absences", "failures", "n_orders"]
KNN_CAT = ["segment", "flag"]


@register("knn_suggest", with_curated("""
, sd AS (SELECT STDDEV_SAMP(effort) AS s FROM curated),
d AS (SELECT c.*, POW((effort - 4.0) / sd.s, 2) + CASE WHEN flag = 'no' THEN 0.0 ELSE 6.25 END AS distance
      FROM curated c, sd),
n AS (SELECT * FROM d ORDER BY distance, subject_id LIMIT 15)
SELECT 'absences' AS field, CAST(CAST(round_even(quantile_cont(absences, 0.5), 0) AS BIGINT) AS VARCHAR) AS value FROM n
UNION ALL SELECT 'failures', CAST(CAST(round_even(quantile_cont(failures, 0.5), 0) AS BIGINT) AS VARCHAR) FROM n
UNION ALL SELECT 'n_orders', CAST(CAST(round_even(quantile_cont(n_orders, 0.5), 0) AS BIGINT) AS VARCHAR) FROM n
UNION ALL SELECT 'segment', (SELECT segment FROM n GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 1)"""))
def q_knn(spark, sf_dir):
    out, _ = SU.suggest(curated(spark, sf_dir), "subject_id", {"effort": 4, "flag": "no", "bogus": 1, "segment": ""},
                        KNN_NUM, KNN_CAT)
    return out


_KNN_ALL = "absences failures n_orders".split()


@register("knn_no_known_field", with_curated(
    "SELECT 'effort' AS field, CAST(CAST(round_even(quantile_cont(effort, 0.5), 0) AS BIGINT) AS VARCHAR) AS value FROM curated "
    + "".join(f"UNION ALL SELECT '{c}', CAST(CAST(round_even(quantile_cont({c}, 0.5), 0) AS BIGINT) AS VARCHAR) FROM curated " for c in _KNN_ALL)
    + "".join(f"UNION ALL SELECT '{c}', (SELECT {c} FROM curated WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) " for c in ("segment", "flag"))))
def q_knn_nothing_known(spark, sf_dir):
    """O-82 with no known field: the whole table is the neighbourhood."""
    out, _ = SU.suggest(curated(spark, sf_dir), "subject_id", {"bogus": 1, "segment": ""}, ["effort", *_KNN_ALL], ["segment", "flag"])
    return out


@register("knn_closest", with_curated("""
, sd AS (SELECT STDDEV_SAMP(effort) AS s FROM curated)
SELECT subject_id, ROUND(POW((effort - 4.0) / sd.s, 2) + CASE WHEN flag = 'no' THEN 0.0 ELSE 6.25 END, 6) AS distance
FROM curated c, sd WHERE effort IS NOT NULL ORDER BY 2, 1 LIMIT 6"""))
def q_knn_closest(spark, sf_dir):
    """O-64: the closest rows shown with the suggestion."""
    _, near = SU.suggest(curated(spark, sf_dir), "subject_id", {"effort": 4, "flag": "no"}, KNN_NUM, KNN_CAT)
    return rounded(near)


# one request for each customer of a segment; what it knows depends on the row
_KNN_FIELDS = ("effort", "absences", "failures", "n_orders", "segment", "flag")
_KNOWS = {"effort": "effort >= 2", "flag": "flag = 'yes'", "absences": "failures >= 1"}
_KNN_BATCH = with_curated("""
, sd AS (SELECT STDDEV_SAMP(effort) AS s_effort, STDDEV_SAMP(absences) AS s_absences FROM curated),
req AS (SELECT subject_id AS request_id, """ + ", ".join(f"CASE WHEN {w} THEN {c} END AS k_{c}" for c, w in _KNOWS.items()) + """
        FROM curated WHERE segment = 'BUILDING'),
d AS (SELECT request_id, k_effort, k_flag, k_absences, c.*, k_effort IS NULL AND k_flag IS NULL AND k_absences IS NULL AS nothing,
             ROUND((CASE WHEN k_effort IS NULL THEN 0.0 ELSE POW((c.effort - k_effort) / s_effort, 2) END)
                   + (CASE WHEN k_absences IS NULL THEN 0.0 ELSE POW((c.absences - k_absences) / s_absences, 2) END)
                   + (CASE WHEN k_flag IS NULL OR c.flag = k_flag THEN 0.0 ELSE 6.25 END), 9) AS distance FROM req, curated c, sd),
n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY distance, subject_id) AS rank FROM d)
      WHERE rank <= 15 OR nothing)
""")


def _requests(df):
    known = [F.when(F.expr(_KNOWS[c]), F.col(c)).alias(c) if c in _KNOWS else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in _KNN_FIELDS]
    return df.filter("segment = 'BUILDING'").select(F.col("subject_id").alias("request_id"), *known)


@register("knn_batch", _KNN_BATCH + " UNION ALL ".join(
    f"SELECT request_id, '{c}' AS field, CAST(CAST(round_even(quantile_cont({c}, 0.5), 0) AS BIGINT) AS VARCHAR) AS value FROM n "
    f"WHERE {f'k_{c} IS NULL' if c in _KNOWS else 'TRUE'} GROUP BY request_id" for c in KNN_NUM)
    + "".join(f""" UNION ALL SELECT request_id, '{c}', {c} FROM (SELECT request_id, {c},
    ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY COUNT(*) DESC, {c}) AS o FROM n
    WHERE {f'k_{c} IS NULL' if c in _KNOWS else 'TRUE'} GROUP BY request_id, {c}) WHERE o = 1""" for c in KNN_CAT))
def q_knn_batch(spark, sf_dir):
    """O-82 for a table of requests: suggested values."""
    df = curated(spark, sf_dir)
    return SU.suggest_many(df, "subject_id", _requests(df), "request_id", KNN_NUM, KNN_CAT)[0]


@register("knn_batch_closest", _KNN_BATCH + """
SELECT request_id, CAST(rank AS INT) AS rank, subject_id, ROUND(distance, 6) AS distance FROM n WHERE rank <= 6 AND NOT nothing""")
def q_knn_batch_closest(spark, sf_dir):
    """O-82/O-64 for a table of requests: the six closest rows of each."""
    df = curated(spark, sf_dir)
    return rounded(SU.suggest_many(df, "subject_id", _requests(df), "request_id", KNN_NUM, KNN_CAT)[1])


NUMERIC_HABITS = ["n_orders", "effort", "failures", "absences"]
CATS = ["segment", "flag"]


@register("train_regression")
def q_train_reg(spark, sf_dir):
    """O-87/O-89/O-90: both variants (without and with prior periods); long metrics table."""
    df = curated(spark, sf_dir)
    variants = [(NUMERIC_HABITS, "habits"), (NUMERIC_HABITS + ["g1", "g2"], "with_periods")]
    res = M._concurrently(lambda v: M.train_regression(df, "subject_id", "g3", v[0], CATS, v[1])[1], variants)
    return res[0].unionByName(res[1])


_LINEAR_INPUTS = {"habits": HABITS, "periods": PERIODS}


def _bucket_sql(salt, n):
    return f"CAST('0x' || substr(md5(CAST(subject_id AS VARCHAR) || '{salt}'), 1, 8) AS BIGINT) % {n}"


def _fold_fit_sql(name, x1, x2):
    """The fit without each fold (-1: with all), and its errors on that fold (-1: on the test rows)."""
    return f""",
b_{name} AS (SELECT {x1} AS x1, {x2} AS x2, g3 AS y, CASE WHEN {_bucket_sql('split', 100)} < 20 THEN -1 ELSE {_bucket_sql('fold', 5)} END AS fold FROM curated),
f_{name} AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f),
s_{name} AS (SELECT f, COVAR_POP(x1, x1) s11, COVAR_POP(x1, x2) s12, COVAR_POP(x2, x2) s22, COVAR_POP(x1, y) s1y, COVAR_POP(x2, y) s2y, AVG(x1) m1, AVG(x2) m2, AVG(y) my
             FROM f_{name} JOIN b_{name} ON fold >= 0 AND fold <> f GROUP BY f),
u_{name} AS (SELECT f, m1, m2, my, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS u1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS u2 FROM s_{name}),
e_{name} AS (SELECT f, y, y - (my + u1 * (x1 - m1) + u2 * (x2 - m2)) AS e FROM u_{name} JOIN b_{name} ON fold = f),
r_{name} AS (SELECT f, 1 - SUM(e * e) / (COUNT(*) * VAR_POP(y)) AS r2, SQRT(AVG(e * e)) AS rmse, AVG(ABS(e)) AS mae FROM e_{name} GROUP BY f),
o_{name} AS (SELECT '{name}' AS variant, AVG(r2) FILTER (WHERE f >= 0) AS cv_r2_mean, STDDEV_POP(r2) FILTER (WHERE f >= 0) AS cv_r2_std,
             MAX(r2) FILTER (WHERE f < 0) AS r2, MAX(rmse) FILTER (WHERE f < 0) AS rmse, MAX(mae) FILTER (WHERE f < 0) AS mae FROM r_{name})"""


@register("linear_cv", with_curated("".join(_fold_fit_sql(n, *x) for n, x in _LINEAR_INPUTS.items())
          + " UNION ALL ".join(f"SELECT variant, {', '.join(f'ROUND({m}, 6) AS {m}' for m in ('cv_r2_mean', 'cv_r2_std', 'r2', 'rmse', 'mae'))} FROM o_{n}" for n in _LINEAR_INPUTS)))
def q_linear_cv(spark, sf_dir):
    """O-87/O-89: cross-validated linear fits of both variants from fold sums, with the test metrics."""
    df = curated(spark, sf_dir)
    test, fold = FS.hash_bucket("subject_id", 100, "split") < 20, FS.hash_bucket("subject_id", 5, "fold")
    rows = []
    for name, inputs in _LINEAR_INPUTS.items():
        fit = FS.linear_folds(df, "g3", inputs, [], fold, 5, test)
        mae = df.where(test).agg(F.avg(F.abs(F.col("g3") - fit.expr()))).first()[0]
        rows.append((name, *fit.cv_r2, fit.test_r2, fit.test_rmse, mae))
    return rounded(spark.createDataFrame(rows, "variant string, cv_r2_mean double, cv_r2_std double, r2 double, rmse double, mae double"))


@register("class_metrics", with_curated(_HAB + f""",
s AS (SELECT passed AS y, {_pred_sql('hab', 'effort', 'absences')} AS p FROM curated, hab),
c AS (SELECT COUNT(*) AS n, SUM(CASE WHEN y = 1 AND p >= 12 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN y = 0 AND p >= 12 THEN 1 ELSE 0 END) AS fp,
             SUM(CASE WHEN y = 1 AND p < 12 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN (y = 1) = (p >= 12) THEN 1 ELSE 0 END) AS ok FROM s),
k AS (SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s),
a AS (SELECT (SUM(r) FILTER (WHERE y = 1) - COUNT(*) FILTER (WHERE y = 1) * (COUNT(*) FILTER (WHERE y = 1) + 1) / 2)
             / NULLIF(COUNT(*) FILTER (WHERE y = 1) * COUNT(*) FILTER (WHERE y = 0), 0) AS auc FROM k),
m AS (SELECT n, ok / n AS accuracy, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS pr, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS re FROM c)
SELECT n, ROUND(accuracy, 6) AS accuracy, ROUND(pr, 6) AS precision, ROUND(re, 6) AS recall, ROUND(COALESCE(2 * pr * re / NULLIF(pr + re, 0), 0), 6) AS f1, ROUND(auc, 6) AS roc_auc FROM m, a"""))
def q_class_metrics(spark, sf_dir):
    """O-89: classification metrics of the linear prediction, taken as a pass from 12 on."""
    df = curated(spark, sf_dir)
    scored = df.select("passed", _scorer(df).expr().alias("score")).withColumn("predicted", (F.col("score") >= 12).cast("int"))
    return rounded(FS.binary_scores(scored, "passed", "predicted", "score"))


@register("one_vs_rest_auc", with_curated("".join(f""",
k{c} AS (SELECT effort = {c} AS y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM (SELECT effort, ROUND(1 / (1 + ABS(g3 - {4 * c})), 2) AS p FROM curated)),
a{c} AS (SELECT {c} AS class, COUNT(*) FILTER (WHERE y) AS n, (SUM(r) FILTER (WHERE y) - COUNT(*) FILTER (WHERE y) * (COUNT(*) FILTER (WHERE y) + 1) / 2)
         / NULLIF(COUNT(*) FILTER (WHERE y) * COUNT(*) FILTER (WHERE NOT y), 0) AS auc FROM k{c})""" for c in (1, 2, 3, 4, 5))
          + " UNION ALL ".join(f"SELECT class, n, ROUND(auc, 6) AS auc FROM a{c}" for c in (1, 2, 3, 4, 5))))
def q_ovr_auc(spark, sf_dir):
    """O-92: areas of one level against the rest, by the closeness of the target to four times the level (one level never occurs)."""
    classes = [1, 2, 3, 4, 5]
    df = curated(spark, sf_dir).select(F.col("effort").cast("int").alias("level"), F.array(*[F.round(1 / (1 + F.abs(F.col("g3") - 4.0 * c)), 2) for c in classes]).alias("scores"))
    return rounded(FS.one_vs_rest_auc(df, "level", "scores", classes))


@register("train_classifier")
def q_train_clf(spark, sf_dir):
    df = curated(spark, sf_dir)
    _, m = M.train_classifier(df, "subject_id", "passed", NUMERIC_HABITS, CATS)
    return m


@register("feature_importance")
def q_importance(spark, sf_dir):
    """O-85: importances of the pass/fail forest with readable feature names, top 15."""
    df = curated(spark, sf_dir).withColumn("passed", F.col("passed").cast("double"))
    train, _ = M.stratified_split(df, "subject_id", "passed")
    pipe = Pipeline(stages=M.preprocessor(NUMERIC_HABITS, CATS) + [RandomForestClassifier(
        labelCol="passed", numTrees=300, maxDepth=8, featureSubsetStrategy="sqrt", seed=M.SEED)])
    pairs = M.feature_importance(pipe.fit(train))
    return spark.createDataFrame(pairs, "feature string, importance double")


@register("batch_score")
def q_batch_score(spark, sf_dir):
    """O-78/O-93: both linear variants and the pass probability for every row; clamped, 2 dp, with the
    test MAE of each variant as the expected error."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression
    df = curated(spark, sf_dir)
    train, test = M.split(df, "subject_id")
    out, cols = df, ["subject_id"]
    for name, inputs in (("habits", NUMERIC_HABITS), ("with_periods", NUMERIC_HABITS + ["g1", "g2"])):
        model = Pipeline(stages=M.preprocessor(inputs, CATS) + [LinearRegression(labelCol="g3")]).fit(train)
        mae = M.score(model, test).agg(F.avg(F.abs(F.col("prediction") - F.col("g3")))).first()[0]
        scored = M.score(model, out.select(*df.columns, *cols[1:]))
        out = scored.select(*df.columns, *cols[1:], F.col("predicted").alias(f"predicted_{name}"),
                            F.lit(mae).cast("double").alias(f"error_{name}"))
        cols += [f"predicted_{name}", f"error_{name}"]
    label = train.withColumn("__y", F.col("passed").cast("double"))
    clf = Pipeline(stages=M.preprocessor(NUMERIC_HABITS, CATS) + [LogisticRegression(labelCol="__y")]).fit(label)
    return M.score(clf, out, prob=True).select(*cols, "pass_probability")


_REQUIRED = ("effort", "g1", "g2")


@register("scoring_rejects", with_curated("""
, m AS (SELECT subject_id, list_filter([""" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _REQUIRED) + """], lambda x: x IS NOT NULL) AS f FROM subjects)
SELECT subject_id, array_to_string(f, ',') AS missing FROM m WHERE len(f) > 0""", upto="subjects"))
def q_scoring_rejects(spark, sf_dir):
    """O-93: rows that a batch can't score, with the inputs that they lack."""
    from pyspark.ml.regression import LinearRegression
    inputs = list(_REQUIRED)
    model = Pipeline(stages=M.preprocessor(inputs, []) + [LinearRegression(labelCol="g3")]).fit(curated(spark, sf_dir))
    return M.score_with_rejects(model, subjects(spark, sf_dir), _REQUIRED)[1].select("subject_id", "missing")


@register("composite_load", with_curated("SELECT subject_id, ROUND((absences * 2.0 + failures * 1.0) / 3.0, 6) AS load FROM curated"))
def q_composite(spark, sf_dir):
    """O-22: a weighted composite of two columns."""
    df = clean.derive_features(curated(spark, sf_dir), SUBJECTS_LOAD)
    return rounded(df.select("subject_id", "load"))


_LI_UNKNOWN = {"l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "R"}  # counted as missing by `model_fill_lineitem`


@register("model_fill_lineitem", """
WITH s AS (SELECT l_orderkey, l_linenumber, NULLIF(CAST(l_discount AS DOUBLE), 0) AS l_discount,
                  NULLIF(CAST(l_tax AS DOUBLE), 0) AS l_tax, NULLIF(l_returnflag, 'R') AS l_returnflag FROM lineitem),
m AS (SELECT QUANTILE_CONT(l_discount, 0.5) AS discount, QUANTILE_CONT(l_tax, 0.5) AS tax FROM s),
f AS (SELECT l_returnflag AS flag FROM s WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, l_linenumber, ROUND(COALESCE(l_discount, discount), 6) AS l_discount,
       ROUND(COALESCE(l_tax, tax), 6) AS l_tax, COALESCE(l_returnflag, flag) AS l_returnflag
FROM s, m, f""")
def q_model_fill(spark, sf_dir):
    """O-86: the fill stage of a pipeline on a fact table, fitted, saved, loaded and applied."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[
        F.nullif(F.col(c).cast("double" if isinstance(v, float) else "string"), F.lit(v)).alias(c) for c, v in _LI_UNKNOWN.items()])
    path = scratch_path(spark, "fill-model")
    Pipeline(stages=[ExactFill(numbers=["l_discount", "l_tax"], texts=["l_returnflag"])]).fit(li).write().save(path)
    return rounded(PipelineModel.load(path).transform(li))


@register("custom_train_lineitem")
def q_custom_li(spark, sf_dir):
    """O-92 on lineitem with a numeric target."""
    li = read(spark, sf_dir, "lineitem").withColumn("__k", F.xxhash64("l_orderkey", "l_linenumber"))
    _, m = M.train_generic(li, "__k", "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag",
                                                          "l_linestatus"])
    return m


@register("custom_train_customer")
def q_custom_cust(spark, sf_dir):
    """O-92 on customer with a text target (market segment)."""
    c = read(spark, sf_dir, "customer")
    _, m = M.train_generic(c, "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return m


SEG_FEATURES = ["effort", "absences", "failures", "n_orders"]


@register("segmentation")
def q_segmentation(spark, sf_dir):
    """O-95 … O-97, O-54: group summary with trait and suggestion codes."""
    _, summary, _ = SG.segment(curated(spark, sf_dir), R, SEG_FEATURES, k=4)
    return rounded(summary.select("group", "size", "share", "mean_target", "risk_share",
                                  F.array_join("trait_codes", ",").alias("trait_codes"), "name",
                                  F.array_join("suggestion_codes", ",").alias("suggestion_codes")))


@register("segment_export")
def q_segment_export(spark, sf_dir):
    """O-10: the members of every group."""
    a, _, _ = SG.segment(curated(spark, sf_dir), R, SEG_FEATURES, k=4)
    return segment_members(a, "group", "subject_id")


# ---------------------------------------------------------------- O-47
@register("peer_comparison", with_curated(_HAB + f"""
, lv AS (SELECT effort AS lvl, AVG(g3) AS level_mean, AVG(passed) AS level_pass_rate, COUNT(*) AS level_n
         FROM curated GROUP BY effort),
p AS (SELECT subject_id, effort, {_pred_sql('hab', 'effort', 'absences')} AS predicted FROM curated, hab)
SELECT subject_id, ROUND(predicted, 6) AS predicted, ROUND(level_mean, 6) AS level_mean,
       ROUND(level_pass_rate, 6) AS level_pass_rate, level_n, ROUND(predicted - level_mean, 6) AS diff_vs_level,
       CAST(predicted >= 10 AS INT) AS predicted_pass
FROM p JOIN lv ON p.effort = lv.lvl"""))
def q_peer(spark, sf_dir):
    """Prediction of every row against its level's mean and pass rate (signed gap)."""
    df = curated(spark, sf_dir)
    sc = _scorer(df)
    lv = df.groupBy(F.col("effort").alias("lvl")).agg(F.avg("g3").alias("level_mean"),
                                                       F.avg("passed").alias("level_pass_rate"),
                                                       F.count(F.lit(1)).alias("level_n"))
    p = df.select("subject_id", "effort", sc.expr().alias("predicted"))
    lv = bounded(lv)
    j = p.join(lv, p.effort == lv.lvl)
    return rounded(j.select("subject_id", "predicted", "level_mean", "level_pass_rate", "level_n",
                            (F.col("predicted") - F.col("level_mean")).alias("diff_vs_level"),
                            (F.col("predicted") >= 10).cast("int").alias("predicted_pass")))


# ---------------------------------------------------------------- O-75
@register("scatter_fit", with_curated("""
SELECT CAST(REGR_COUNT(g3, absences) AS BIGINT) AS n, ROUND(REGR_SLOPE(g3, absences), 6) AS slope,
       ROUND(REGR_INTERCEPT(g3, absences), 6) AS intercept, ROUND(REGR_R2(g3, absences), 6) AS r2,
       ROUND(MIN(absences), 6) AS x_min, ROUND(MAX(absences), 6) AS x_max,
       ROUND(REGR_INTERCEPT(g3, absences) + REGR_SLOPE(g3, absences) * MIN(absences), 6) AS y_at_min,
       ROUND(REGR_INTERCEPT(g3, absences) + REGR_SLOPE(g3, absences) * MAX(absences), 6) AS y_at_max FROM curated"""))
def q_scatter(spark, sf_dir):
    from ..operators import stats as S
    _, line = S.scatter(curated(spark, sf_dir), "absences", "g3", "subject_id")
    return rounded(line)


@register("scatter_points", with_curated(
    "SELECT subject_id, absences AS x, g3 AS y FROM curated WHERE absences IS NOT NULL AND g3 IS NOT NULL"))
def q_scatter_points(spark, sf_dir):
    """O-75: every point."""
    from ..operators import stats as S
    return S.scatter(curated(spark, sf_dir), "absences", "g3", "subject_id")[0]


# ---------------------------------------------------------------- O-91
SCENARIOS = (("current", 0.0, 0.0), ("effort_up", 1.0, 0.0), ("absences_down", 0.0, -3.0))


@register("scenario_table", with_curated(_HAB + ", s AS (" + " UNION ALL ".join(
    f"SELECT subject_id, '{n}' AS scenario, {i} AS o, LEAST(GREATEST(effort + {de}, 1.0), 4.0) AS effort, "
    f"LEAST(GREATEST(absences + {da}, 0.0), 93.0) AS absences FROM curated" for i, (n, de, da) in enumerate(SCENARIOS))
    + f"""),
p AS (SELECT s.*, {_pred_sql('hab', 's.effort', 's.absences')} AS pred FROM s, hab),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY pred DESC, o) AS rk FROM p)
SELECT subject_id, scenario, ROUND(effort, 6) AS effort, ROUND(absences, 6) AS absences, ROUND(pred, 6) AS pred,
       rk = 1 AS is_best FROM r"""))
def q_scenarios(spark, sf_dir):
    """Frozen scenario inputs and their predictions side by side; the best one marked."""
    df = curated(spark, sf_dir)
    sc = _scorer(df)
    items = []
    for i, (n, de, da) in enumerate(SCENARIOS):
        e = F.least(F.greatest(F.col("effort") + de, F.lit(1.0)), F.lit(4.0))
        a = F.least(F.greatest(F.col("absences") + da, F.lit(0.0)), F.lit(93.0))
        items.append(F.struct(F.lit(n).alias("scenario"), F.lit(i).alias("o"), e.alias("effort"), a.alias("absences"),
                              sc.expr({"effort": e, "absences": a}).alias("pred")))
    arr = F.array(*items)
    best = F.array_max(F.transform(arr, lambda s: F.named_struct(F.lit("p"), s["pred"], F.lit("k"), -s["o"])))["k"]
    ex = df.select("subject_id", (-best).alias("best_o"), F.explode(arr).alias("s"))
    return rounded(ex.select("subject_id", "s.scenario", "s.effort", "s.absences", "s.pred",
                             (F.col("s.o") == F.col("best_o")).alias("is_best")))
