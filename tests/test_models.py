"""Training functions on a small table with few trees."""
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import models as M


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(i % 10), float(i * 7 % 13), "a" if i % 3 else "b", 2.0 * (i % 10) + (i * 7 % 13) % 3, int(i % 10 > 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, z double, c string, y double, passed int")
    return df.withColumn("label_source", F.lit("observed")).unionByName(
        df.limit(50).withColumns({"k": F.col("k") + 1000, "y": F.lit(500.0), "passed": F.lit(0), "label_source": F.lit("imputed")})).cache()


def metrics(frame):
    return {(r["model"], r["metric"]): r["value"] for r in frame.collect()}


def test_regression_ignores_imputed_targets(data):
    model, frame = M.train_regression(data, "k", "y", ["x", "z"], ["c"], "v", trees=5, depth=3, folds=2, rounds=2)
    m = metrics(frame)
    assert m["linear", "r2"] > 0.9 and m["linear", "improvement_pct"] > 50 and m["linear", "cv_r2_std"] >= 0
    assert m["mean_baseline", "mae"] < 20
    assert model.transform(data).count() == 450


def test_classifier_reports_positive_class_folds(data):
    _, frame = M.train_classifier(data, "k", "passed", ["x", "z"], ["c"], trees=5, depth=3, folds=2, rounds=2)
    m = metrics(frame)
    assert m["logistic", "f1"] > 0.9 and 0.9 < m["logistic", "cv_f1_mean"] <= 1 and m["logistic", "cv_f1_std"] is not None


@pytest.mark.parametrize("target", ["y", "c"])
def test_generic_training_leaves_nothing_cached(spark, data, target):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    _, frame = M.train_generic(data, "k", target, [c for c in ("x", "z", "passed") if c != target], trees=5, depth=3)
    m = metrics(frame)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert {k for k, _ in m} == ({"linear", "random_forest"} if target == "y" else {"logistic", "random_forest"})
    if target == "c":
        assert 0 <= m["logistic", "roc_auc"] <= 1


def test_weighted_auc_is_undefined_without_a_class(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(0.0, Vectors.dense(0.9, 0.1)), (0.0, Vectors.dense(0.2, 0.8))], ["l", "probability"])
    assert M.weighted_auc(df, "l") is None
    df = spark.createDataFrame([(0.0, Vectors.dense(0.9, 0.1)), (1.0, Vectors.dense(0.2, 0.8))], ["l", "probability"])
    assert M.weighted_auc(df, "l") == 1.0


def test_large_training_parts_are_spread(spark, monkeypatch):
    """A table of one file part gives work to all cores; small tables keep the layout that they have."""
    rows = spark.range(0, 400, 1, 1).selectExpr("id AS k", "id % 10 AS x")
    assert M.spread(rows, 400).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "SMALL_ROWS", 100)
    monkeypatch.setattr(M, "ROWS_A_PART", 200)
    wide = M.spread(rows, 400)
    assert wide.rdd.getNumPartitions() == 2 and sorted(wide.collect()) == sorted(rows.collect())
    monkeypatch.setattr(M, "ROWS_A_PART", 1)
    assert M.spread(rows, 400).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_folds_equal_the_cross_validator_and_the_whole_part_does_not_wait(data, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    train = data.withColumn("__fold", (F.col("k") % 3).cast("int"))
    pipe = Pipeline(stages=M.preprocessor(["x", "z"], ["c"]) + [GBTRegressor(labelCol="y", maxIter=3, maxDepth=2, seed=1)])
    r2 = RegressionEvaluator(labelCol="y", metricName="r2")
    whole = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=r2, foldCol="__fold", numFolds=3).fit(train)
    began = []
    together = M._concurrently
    monkeypatch.setattr(M, "_concurrently", lambda fn, items: began.append(list(items)) or together(fn, items))
    model, cv = M._fit_with_folds(pipe, train, 3, r2)
    assert began == [[None, 0, 1, 2]]  # one round for the folds and the whole part
    assert sum(cv) / 3 == pytest.approx(whole.avgMetrics[0], abs=1e-9)
    assert r2.evaluate(model.transform(train)) == pytest.approx(r2.evaluate(whole.bestModel.transform(train)), abs=1e-9)
    with pytest.raises(ValueError, match="fold 3"):
        M._fit_with_folds(pipe, train, 4, r2)
