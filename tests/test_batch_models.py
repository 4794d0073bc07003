"""Batch suggestions, the one-pass test battery, what-if by scored rows, frontier plans, fold sums and rank-sum areas."""
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from cohortlens.functions import pvalues as P
from cohortlens.operators import foldsums as FS
from cohortlens.operators import models as M
from cohortlens.operators import stats as S
from cohortlens.operators import suggest as SU
from cohortlens.operators import whatif as W
from cohortlens.roles import Roles

NUM, CAT = ["a", "b", "flat"], ["c", "d"]


@pytest.fixture(scope="module")
def people(spark):
    r = random.Random(5)
    rows = [(i, float(r.randrange(4)) if r.random() > 0.1 else None, float(r.randrange(6)), 3.0, r.choice("xyz") if r.random() > 0.1 else None, r.choice("uv")) for i in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, flat double, c string, d string").cache()


# suggestions for many requests


@pytest.mark.parametrize("block", [2048, 3])
def test_many_requests_equal_one_by_one(spark, people, block):
    asks = [(1, 2.0, None, None, "x", None), (2, 2.0, None, None, "x", None), (3, None, None, None, None, None), (4, 1.0, 5.0, 3.0, "y", "v"), (5, None, 4.0, None, "", "u"),
            (6, 0.5, 2.5, None, None, None), (7, None, None, 3.0, "absent", None), (8, None, None, 9.0, None, None)]
    requests = spark.createDataFrame(asks, "rid long, a double, b double, flat double, c string, d string")
    answers, closest = SU.suggest_many(people, "id", requests, "rid", NUM, CAT, block=block)
    got = {(r["rid"], r["field"]): r["value"] for r in answers.collect()}
    near = {}
    for r in sorted(closest.collect(), key=lambda r: (r["rid"], r["rank"])):
        near.setdefault(r["rid"], []).append((r["id"], round(r["distance"], 6)))
    want, want_near = {}, {}
    for rid, *values in asks:
        out, rows = SU.suggest(people, "id", dict(zip(NUM + CAT, values)), NUM, CAT)
        want.update({(rid, r["field"]): r["value"] for r in out.collect()})
        shown = [(r["id"], round(r["distance"], 6)) for r in rows.collect()] if any(v not in (None, "") for v in values) and rid != 4 else []
        if shown:
            want_near[rid] = shown
    assert got == want and near == want_near


def test_requests_meet_distinct_tuples_only(spark, people):
    wide = people.unionByName(people.withColumn("id", F.col("id") + 1000)).unionByName(people.withColumn("id", F.col("id") + 2000))
    requests = people.select(F.col("id").alias("rid"), "a", F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("flat"), "c", F.lit(None).cast("string").alias("d"))
    answers, _ = SU.suggest_many(wide, "id", requests, "rid", NUM, CAT)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {r["rid"] for r in answers.select("rid").distinct().collect()} == set(range(300))


def test_no_request_and_no_reference(spark, people):
    requests = spark.createDataFrame([], "rid long, a double, b double, flat double, c string, d string")
    answers, closest = SU.suggest_many(people, "id", requests, "rid", NUM, CAT)
    assert answers.count() == 0 and closest.count() == 0
    asked = spark.createDataFrame([(1, 2.0, None, None, None, None)], requests.schema)
    answers, closest = SU.suggest_many(people.limit(0), "id", asked, "rid", NUM, CAT)
    assert closest.count() == 0 and answers.where("value is not null").count() == 0


# p-values and the battery


def test_p_value_columns_equal_the_plain_function(spark):
    r = random.Random(1)
    rows = [(r.choice([0.0, 0.1, 1.0, 2.5, 9.0, 60.0]) * r.random(), r.choice([1.0, 2.0, 7.5, 40.0, 600.0]), r.choice([1.0, 3.0, 12.0, 900.0])) for _ in range(150)]
    df = spark.createDataFrame(rows, "s double, d1 double, d2 double")
    for x in df.select("*", P.p_value_t(F.col("s"), F.col("d1")).alias("t"), P.p_value_f(F.col("s"), F.col("d1"), F.col("d2")).alias("f")).collect():
        assert x["t"] == pytest.approx(P.t_two_sided(x["s"], x["d1"]), rel=1e-9, abs=1e-14)
        assert x["f"] == pytest.approx(P.f_upper(x["s"], x["d1"], x["d2"]), rel=1e-9, abs=1e-14)


def test_p_value_columns_of_odd_input(spark):
    df = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (1.0, -2.0), (math.nan, 3.0), (math.inf, 3.0), (1.0, math.inf)], "s double, d double")
    assert [r[0] for r in df.select(P.p_value_t(F.col("s"), F.col("d"))).collect()] == [None] * 7
    (big,) = spark.createDataFrame([(1.959963985,)], "s double").select(P.p_value_t(F.col("s"), F.lit(1e10))).first()
    assert big == pytest.approx(0.05, rel=1e-6)


def test_battery_is_one_scan_and_equals_single_tests(spark, people):
    df = people.withColumn("y", F.col("b") * 2 + F.coalesce("a", F.lit(0.0)) + F.col("id") % 7).withColumn("two", (F.col("id") % 2) * 8 + 2)
    out = S.test_battery(df, "y", two_group=["d", "two"], multi_group=["c", "a"], regressors=["a", "b", "flat"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    got = {(r["test"], r["factor"]): r for r in out.collect()}
    for g in ("d", "two"):
        one = S.welch(df, g, "y").first()
        assert got["welch", g]["statistic"] == pytest.approx(one["t"]) and got["welch", g]["df1"] == pytest.approx(one["df"])
    for g in ("c", "a"):
        one = S.anova(df, g, "y").first()
        assert got["anova", g]["statistic"] == pytest.approx(one["f"]) and got["anova", g]["df2"] == one["df_within"]
        assert got["anova", g]["p_value"] == pytest.approx(P.f_upper(one["f"], one["df_between"], one["df_within"]))
    for x in ("a", "b"):
        one = S.ols(df, x, "y").first()
        assert got["ols", x]["statistic"] == pytest.approx(one["t"]) and got["ols", x]["p_value"] == pytest.approx(P.t_two_sided(one["t"], one["df"]))
    assert got["ols", "flat"]["statistic"] is None and got["ols", "flat"]["significant"] is None


def test_battery_refuses_three_groups(spark, people):
    with pytest.raises(Exception, match="exactly 2 groups"):
        S.test_battery(people, "b", two_group=["c"]).collect()
    with pytest.raises(ValueError):
        S.test_battery(people, "b")


# what-if by scored rows

ROLES = Roles(id="id", target="y", numeric=("a", "b"), categorical=("c",), levers=(("a", 0.0, 3.0, 1.0, 1), ("b", 0.0, 9.0, 1.0, -1)))


@pytest.fixture(scope="module")
def subjects(spark):
    r = random.Random(9)
    rows = [(i, float(r.randrange(4)), float(r.randrange(7)), r.choice("xyz")) for i in range(120)]
    rows = [(*x, 8.0 + 2 * x[1] - 0.9 * x[2] + {"x": 0, "y": 1, "z": -2}[x[3]] + (x[1] >= 2) * (x[2] < 3) * 3 + r.random()) for x in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double").cache()


@pytest.fixture(scope="module")
def forest(subjects):
    model = Pipeline(stages=M.preprocessor(["a", "b"], ["c"]) + [RandomForestRegressor(labelCol="y", numTrees=7, maxDepth=4, seed=3)]).fit(subjects)
    return W.ModelScorer(model, ("a", "b", "c"))


@pytest.fixture(scope="module")
def predict(spark, forest):
    """The model's answer for every combination of inputs."""
    grid = [(a, b, c) for a in range(4) for b in range(10) for c in "xyz"]
    scored = forest.score(spark.createDataFrame([(float(a), float(b), c) for a, b, c in grid], "a double, b double, c string"))
    table = {(r["a"], r["b"], r["c"]): r["pred"] for r in scored.collect()}
    return lambda a, b, c: table[a, b, c]


LEVERS = [("a", 1.0, lambda v: v < 3.0), ("b", -1.0, lambda v: v > 0.0)]


def near(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def tries(row):
    for k, (name, move, ok) in enumerate(LEVERS):
        if ok(row[name]):
            yield k, name, move, {**row, name: row[name] + move}


def test_quick_wins_of_a_forest_equal_single_predictions(subjects, forest, predict):
    want = []
    for r in subjects.collect():
        row = {c: r[c] for c in "abc"}
        base = predict(**row)
        gains = sorted((-round(predict(**new) - base, 2), k, name, row[name], new[name]) for k, name, _, new in tries(row) if round(predict(**new) - base, 2) > 0)
        want += [(r["id"], i, name, x, y, -g) for i, (g, _, name, x, y) in enumerate(gains[:1], 1)]
    got = W.quick_wins_scored(subjects, ROLES, forest, "id", limit=1).collect()
    assert near(got) == near(want)


def test_explanations_of_a_forest_equal_single_predictions(subjects, forest, predict):
    typical, want = {"a": 2.0, "b": 3.0, "c": "y"}, []
    for r in subjects.collect():
        row = {c: r[c] for c in "abc"}
        base = predict(**row)
        impacts = [(round(base - predict(**{**row, c: typical[c]}), 2), k, c) for k, c in enumerate("abc") if row[c] != typical[c]]
        impacts = sorted((x for x in impacts if abs(x[0]) >= 0.05), key=lambda x: (-abs(x[0]), x[1]))
        want += [(r["id"], base, i, c, str(row[c]), str(typical[c]), impact) for i, (impact, _, c) in enumerate(impacts, 1)]
    assert near(W.explain_scored(subjects, forest, "id", typical).collect()) == near(want)
    assert W.explain_scored(subjects.limit(0), forest, "id", typical).count() == 0


@pytest.mark.parametrize("steps", [0, 2, 80])
def test_plans_of_a_forest_equal_a_greedy_loop(subjects, forest, predict, steps):
    want = {}
    for r in subjects.collect():
        row, log, n = {c: r[c] for c in "abc"}, [], 0
        p = predict(**row)
        while p < 13.0 and n < steps:
            best = max(((round(predict(**new) - p, 2), -k, name, new) for k, name, _, new in tries(row)), key=lambda x: x[:2], default=(0,))
            if best[0] <= 0:
                break
            _, _, name, new = best
            if log and log[-1][0] == name:
                log[-1] = (name, log[-1][1], new[name])
            else:
                log.append((name, row[name], new[name]))
            row, n = new, n + 1
            p = predict(**row)
        want[r["id"]] = (p, n, p >= 13.0, log)
    got = W.greedy_plan_scored(subjects, ROLES, forest, "id", 13.0, max_steps=steps).collect()
    assert {r["id"]: (r["final_pred"], r["steps"], r["reached"], [tuple(c) for c in r["changes"]]) for r in got} == want and len(got) == 120


def test_linear_plan_by_rounds_equals_the_expression(subjects):
    linear = W.LinearScorer.fit(subjects, ("a", "b"), "y")
    one = W.greedy_plan(subjects, ROLES, linear, "id", 12.0).select("id", "final_pred", "steps", "reached", "changes")
    two = W.greedy_plan_scored(subjects, ROLES, linear, "id", 12.0)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert W.greedy_plan_scored(subjects.limit(0), ROLES, linear, "id", 12.0).count() == 0


def test_constant_and_repeated_inputs_get_no_weight(spark, subjects):
    df = subjects.withColumns({"one": F.lit(4.0), "twice": 2 * F.col("a")})
    plain = W.LinearScorer.fit(df, ("a", "b"), "y")
    odd = W.LinearScorer.fit(df, ("one", "a", "twice", "b"), "y")
    assert (odd.coefs[0], odd.coefs[2]) == (0, 0) and (odd.coefs[1], odd.coefs[3]) == plain.coefs and odd.intercept == plain.intercept
    flat = W.LinearScorer.fit(df, ("one",), "y")
    assert flat.coefs == (0,) and float(flat.intercept) == pytest.approx(df.agg(F.avg("y")).first()[0], abs=1e-6)
    with pytest.raises(ValueError):
        W.LinearScorer.fit(df.limit(0), ("a",), "y")


# fold sums and areas


def test_fold_sums_equal_cross_validation(subjects):
    df = subjects.withColumn("__fold", (F.col("id") % 4).cast("int"))
    fit = FS.linear_folds(df, "y", ["a", "b"], ["c"], F.col("__fold"), 4, F.lit(False))
    cv = CrossValidator(estimator=Pipeline(stages=M.preprocessor(["a", "b"], ["c"]) + [LinearRegression(labelCol="y")]), estimatorParamMaps=ParamGridBuilder().build(),
                        evaluator=RegressionEvaluator(labelCol="y", metricName="r2"), foldCol="__fold", numFolds=4).fit(df)
    assert fit.cv_r2[0] == pytest.approx(cv.avgMetrics[0], abs=1e-6) and fit.cv_r2[1] == pytest.approx(cv.stdMetrics[0], abs=1e-6)
    model = cv.bestModel.transform(df).withColumn("mine", fit.expr())
    assert model.agg(F.max(F.abs(F.col("mine") - F.col("prediction")))).first()[0] < 1e-6


def test_fold_sums_of_odd_tables(spark, subjects):
    test = F.col("id") < 20
    df = subjects.withColumns({"flat": F.lit(1.0), "far": F.col("a") + 1e6, "c": F.when(F.col("id") % 9 > 0, F.col("c"))}).withColumn("f", (F.col("id") % 3).cast("int"))
    fit = FS.linear_folds(df, "y", ["far", "flat", "b"], ["c"], F.col("f"), 5, test)  # two folds have no row
    assert fit.fold_r2[3:] == (None, None) and all(r is not None for r in fit.fold_r2[:3]) and fit.coefs[1] == 0
    held = df.where(test).select("y", fit.expr().alias("p")).toPandas()
    e = held["y"] - held["p"]
    assert fit.test_rmse == pytest.approx(np.sqrt((e ** 2).mean())) and fit.test_r2 == pytest.approx(1 - (e ** 2).sum() / ((held["y"] - held["y"].mean()) ** 2).sum())
    empty = FS.linear_folds(df.limit(0), "y", ["b"], [], F.col("f"), 2, test)
    assert empty.cv_r2 == (None, None) and empty.test_r2 is None
    with pytest.raises(ValueError, match="combinations"):
        FS.linear_folds(spark.range(30_000).selectExpr("CAST(id AS STRING) AS c", "1.0 AS y", "1.0 AS x"), "y", ["x"], ["c"], F.lit(0), 1, F.lit(False))


def test_areas_equal_the_evaluator(spark, subjects):
    df = subjects.withColumn("k", (F.col("y") > 12).cast("double"))
    model = Pipeline(stages=M.preprocessor(["a", "b"], ["c"]) + [LogisticRegression(labelCol="k")]).fit(df)
    scored = model.transform(df)
    want = BinaryClassificationEvaluator(labelCol="k", rawPredictionCol="probability").evaluate(scored)
    assert M.weighted_auc(scored, "k") == pytest.approx(want, abs=1e-9)
    assert M.weighted_auc(scored.where("k = 1"), "k") is None and M.weighted_auc(scored.limit(0), "k") is None
    three = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.9, 0.8]), (1, [0.2, None]), (None, [0.5, 0.5])], "y int, p array<double>")
    assert {r["class"]: (r["n"], r["auc"]) for r in FS.one_vs_rest_auc(three, "y", "p", [0, 1]).collect()} == {0: (1, 0.75), 1: (1, 1.0)}


def test_binary_scores_of_undefined_cases(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.4), (None, 1, 0.5)], "y int, p int, s double")
    assert tuple(FS.binary_scores(df, "y", "p", "s").first()) == (2, 1.0, 0.0, 0.0, 0.0, None)
    assert FS.binary_scores(df.limit(0), "y", "p", "s").first()["n"] == 0
