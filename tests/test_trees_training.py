"""Large training parts of the two comparisons are grown on cells, small ones by Spark."""
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import models as M
from cohortlens.operators import trees as B


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(0, 500, 1, 3).selectExpr("id k", "id * 37 % 41 + 0.25 x", "id * 7 % 13 + 0.0 z", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END c")
    return df.withColumn("y", F.round(F.col("x") * 0.3 + F.col("z") + F.col("k") % 7, 2)).withColumn("passed", (F.col("y") > 14).cast("int")).cache()


def both(train, monkeypatch):
    """Metrics of Spark's trees and of those on cells, and the estimators that were grown on cells."""
    read = lambda frame: {(r["model"], r["metric"]): r["value"] for r in frame.collect()}
    small = read(train()[1])
    monkeypatch.setattr(M, "SMALL_ROWS", 100)
    began, fit = [], B.fit
    monkeypatch.setattr(B, "fit", lambda c, est: began.append(type(est).__name__) or fit(c, est))
    return small, read(train()[1]), sorted(began)


def test_regression_of_a_large_part(data, monkeypatch):
    small, large, began = both(lambda: M.train_regression(data, "k", "y", ["x", "z"], ["c"], "v", trees=6, depth=3, folds=2, rounds=2), monkeypatch)
    assert began == ["GBTRegressor", "RandomForestRegressor"] and {k for k in large if k[1] != "is_best"} == {k for k in small if k[1] != "is_best"}
    for k, v in small.items():
        close = {"rel": 0.3, "abs": 0.3} if k[0] == "random_forest" else {"abs": 1e-6}
        if k[1] != "is_best":
            assert large[k] == pytest.approx(v, **close), k


def test_classifier_of_a_large_part(data, monkeypatch):
    small, large, began = both(lambda: M.train_classifier(data, "k", "passed", ["x", "z"], ["c"], trees=6, depth=3, folds=2, rounds=2), monkeypatch)
    assert began == ["GBTClassifier", "RandomForestClassifier"]  # the logistic one isn't made of trees
    for k, v in small.items():
        close = {"abs": 0.15} if k[0] == "random_forest" else {"abs": 1e-6}
        if k[1] != "is_best":
            assert large[k] == pytest.approx(v, **close), k
