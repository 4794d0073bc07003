"""Trees grown on cells against Spark's own."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from cohortlens.operators import models as M
from cohortlens.operators import trees as B


def kind(name):
    """Estimator, label and score; made inside a test, as they need a session."""
    r2, f1 = RegressionEvaluator(labelCol="y", metricName="r2"), MulticlassClassificationEvaluator(labelCol="p", metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)
    return {"boosted numbers": lambda: (GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.1, seed=1), "y", r2),
            "boosted classes": lambda: (GBTClassifier(labelCol="p", maxIter=4, maxDepth=3, stepSize=0.1, seed=1), "p", f1),
            "forest of numbers": lambda: (RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=4, featureSubsetStrategy="all", seed=1), "y", r2),
            "forest of classes": lambda: (RandomForestClassifier(labelCol="p", numTrees=20, maxDepth=4, featureSubsetStrategy="sqrt", seed=1), "p", f1)}[name]()


@pytest.fixture(scope="module")
def train(spark):
    """600 rows, some of them twice, with more values of x than bins; __fold of two. Two levels, as splits of equal gain are chosen by rounding."""
    df = spark.range(0, 600, 1, 3).selectExpr("id k", "id * 37 % 101 + 0.25D x", "id * 7 % 13 + 0D z", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END c")
    df = df.withColumn("y", F.round(F.col("x") * 0.3 + F.col("z") * F.when(F.col("c") == "a", 1.5).otherwise(-0.5) + F.xxhash64("k") % 100 / 40, 2)).withColumn("p", (F.col("y") > 12).cast("double"))
    return df.unionByName(df.where("k < 100")).withColumn("__fold", (F.col("k") % 2).cast("int")).cache()


def in_cells(train, label, binary=False, folds=2):
    return B.cells(Pipeline(stages=M.preprocessor(["x", "z"], ["c"])).fit(train), train, ["x", "z"], ["c"], label, 700, folds, binary)


def predictions(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("k").select("prediction").collect()])


@pytest.mark.parametrize("merged", [200_000, 0])
@pytest.mark.parametrize("name", ["boosted numbers", "boosted classes"])
def test_boosting_on_cells_is_sparks(train, monkeypatch, merged, name):
    est, label, score = kind(name)
    monkeypatch.setattr(B, "MERGED_CELLS", merged)
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 2)
    c = in_cells(train, label, label == "p")
    assert (c.merged is None) == (merged == 0)
    model, cv = B.fit(c, est)
    c.unpersist()
    spark_model, spark_cv = M._fit_with_folds(Pipeline(stages=M.preprocessor(["x", "z"], ["c"]) + [est]), train, 2, score)
    assert cv == pytest.approx(spark_cv, abs=2e-3)  # rounding may choose between splits of equal gain
    assert np.abs(predictions(model, train) - predictions(spark_model, train)).mean() < 0.02
    assert model.stages[-1].getNumTrees == 4 and list(model.stages[-1].treeWeights) == [1.0, 0.1, 0.1, 0.1]


@pytest.mark.parametrize("name", ["forest of numbers", "forest of classes"])
def test_forest_on_cells(train, monkeypatch, tmp_path, name):
    """The same forest with and without merged cells, as good as Spark's; an ordinary model of all its trees."""
    est, label, score = kind(name)
    found = []
    for merged in (200_000, 0):
        monkeypatch.setattr(B, "MERGED_CELLS", merged)
        monkeypatch.setattr(B, "BATCH_BYTES", 400_000)
        c = in_cells(train, label, label == "p")
        found.append(B.fit(c, est))
        c.unpersist()
    (model, cv), (other, other_cv) = found
    assert cv == pytest.approx(other_cv, abs=1e-9)
    assert predictions(model, train) == pytest.approx(predictions(other, train), abs=1e-9)
    spark_model, spark_cv = M._fit_with_folds(Pipeline(stages=M.preprocessor(["x", "z"], ["c"]) + [est]), train, 2, score)
    assert cv == pytest.approx(spark_cv, abs=0.06)
    assert score.evaluate(model.transform(train)) == pytest.approx(score.evaluate(spark_model.transform(train)), abs=0.06)
    forest = model.stages[-1]
    assert forest.getNumTrees == 20 and max(t.depth for t in forest.trees) == 4
    assert forest.featureImportances.toArray() == pytest.approx(spark_model.stages[-1].featureImportances.toArray(), abs=0.15)
    model.write().save(str(tmp_path / "m"))
    assert predictions(PipelineModel.load(str(tmp_path / "m")), train) == pytest.approx(predictions(model, train))


def test_one_tree_without_draws_is_sparks(train, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor
    monkeypatch.setattr(B, "_draws", lambda b, *_: np.ones(len(b.y), int) if b.times is None else b.times)
    for merged in (200_000, 0):
        monkeypatch.setattr(B, "MERGED_CELLS", merged)
        c = in_cells(train, "y", folds=0)
        g, stats = B.forest(c, 1, 5, "all", 1)
        model = B._spark_model(c, RandomForestRegressor(labelCol="y", maxDepth=5), "numTrees", g, np.ones(1), stats, False)
        c.unpersist()
        own = Pipeline(stages=M.preprocessor(["x", "z"], ["c"]) + [DecisionTreeRegressor(labelCol="y", maxDepth=5)]).fit(train)
        prepared = c.pre.transform(train)
        assert predictions(model, prepared) == pytest.approx(predictions(own, train), abs=1e-9)
        assert model.trees[0].numNodes == own.stages[-1].numNodes


def test_poisson_draws():
    """The table of 16 bits agrees with the distribution."""
    u = np.arange(1 << 16)
    known = B._FIRST != 255
    assert (~known).sum() < 20
    for share in (0.0, 0.5, 0.999):
        assert (B._FIRST[known] == np.searchsorted(B._POISSON, (u[known] + share) / 65536, "right")).all()
    b = B.Block(None, None, None, None, np.zeros(400_000), None)
    w = B._draws(b, 42, 0, 0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert (w == B._draws(b, 42, 0, 0)).all() and (w != B._draws(b, 42, 0, 1)).any()


def test_inputs_of_many_values_are_cut_at_percentiles(train, monkeypatch):
    monkeypatch.setattr(B, "MOST_VALUES", 20)
    c = in_cells(train, "y")
    cuts = c.plan.cuts[0][0]
    c.unpersist()
    scaled = sorted((r["x"] - c.plan.shift[0]) * c.plan.scale[0] for r in train.select("x").collect())
    assert 20 < len(cuts) <= 31 and abs(np.searchsorted(scaled, cuts[len(cuts) // 2]) - 350) < 40


def test_empty_fold_is_an_error(train):
    with pytest.raises(ValueError, match="validation data of fold 2"):
        in_cells(train, "y", folds=3)


def test_large_generic_training_grows_on_cells(train, monkeypatch):
    """Up to SMALL_ROWS rows Spark's forest, above it cells: the same metrics but for the draws, and nothing left cached."""
    small = {(r["model"], r["metric"]): r["value"] for r in M.train_generic(train, "k", "y", ["x", "z", "c"], trees=10, depth=4)[1].collect()}
    monkeypatch.setattr(M, "SMALL_ROWS", 100)
    began, fit = [], B.fit
    monkeypatch.setattr(B, "fit", lambda c, est: began.append(type(est).__name__) or fit(c, est))
    sc = train.sparkSession.sparkContext
    before = sc._jsc.getPersistentRDDs().size()
    model, frame = M.train_generic(train, "k", "y", ["x", "z", "c"], trees=10, depth=4)
    large = {(r["model"], r["metric"]): r["value"] for r in frame.collect()}
    assert began == ["RandomForestRegressor"] and sc._jsc.getPersistentRDDs().size() == before
    assert large.keys() == small.keys()
    assert large["linear", "r2"] == pytest.approx(small["linear", "r2"], abs=1e-6)
    assert large["random_forest", "r2"] == pytest.approx(small["random_forest", "r2"], abs=0.05)
    assert model.transform(train).count() == 700
