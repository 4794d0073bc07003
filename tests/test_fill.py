"""The fill stage against numpy, saved and loaded, and the odd cases of its docstring."""
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression

from cohortlens.operators import models as M
from cohortlens.operators.fill import NONE, ExactFill, ExactFillModel

SCHEMA = "id int, a double, b int, t string, __num__ string"
ROWS = [(1, 1.0, 4, "y", "k"), (2, None, None, None, None), (3, math.nan, 7, "x", "k"), (4, 8.0, 9, "x", "k"),
        (5, 2.5, None, "y", "k"), (5, 2.5, None, "y", "k"), (6, 1e6, 1, "x", "k"), (7, None, 2, "", "k")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_fill_equals_numpy_medians_and_lowest_modes(table):
    model = ExactFill(numbers=["a", "b"], texts=["t"]).fit(table)
    assert model.getOrDefault("medians") == [np.median([1.0, 8.0, 2.5, 2.5, 1e6]), np.median([4, 7, 9, 1, 2])]
    assert model.getOrDefault("modes") == ["x"]
    got = model.transform(table)
    assert got.columns == table.columns
    want = sorted((i, 2.5 if a is None or math.isnan(a) else a, 4.0 if b is None else float(b), t or "x", str(o)) for i, a, b, t, o in ROWS)
    assert sorted((*r[:4], str(r[4])) for r in got.collect()) == want


def test_saved_pipeline_fills_alike(spark, table, tmp_path):
    pipe = Pipeline(stages=M.preprocessor(["a", "b"], ["t"], impute=True) + [LinearRegression(labelCol="id")])
    pipe.write().save(str(tmp_path / "pipe"))
    model = Pipeline.load(str(tmp_path / "pipe")).fit(table)
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(again.stages[0], ExactFillModel) and again.stages[0].getOrDefault("medians") == [2.5, 4.0]
    new = spark.createDataFrame([(1, None, None, None, None), (2, 3.0, 1, "unseen", None)], SCHEMA)
    rows = [m.transform(new).select("a", "b", "t", "prediction").collect() for m in (model, again)]
    assert rows[0] == rows[1] and tuple(rows[0][0][:3]) == (2.5, 4.0, "x")


def test_training_part_alone_gives_the_fill(spark, table):
    train = table.where("id <= 4")
    model = Pipeline(stages=M.preprocessor(["a"], [], impute=True)).fit(train)
    assert [r["a"] for r in model.transform(table.where("id = 7")).collect()] == [4.5]


def test_generic_model_carries_its_fill(spark):
    rows = [(i, float(i % 7) if i % 5 else None, ["u", "v", None][i % 3], float(i % 7) * 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, t string, y double")
    model, metrics = M.train_generic(df, "id", "y", ["x", "t"], trees=3, depth=3)
    assert model.stages[0].getOrDefault("medians") == [np.median([r[1] for r in rows if r[1] is not None])]
    lost = spark.createDataFrame([(1, None, None, None)], df.schema)
    assert model.transform(lost).first()["prediction"] is not None and metrics.count() > 0


def test_columns_without_values_and_empty_tables(spark, table):
    nulls = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    for t in (nulls, table.limit(0)):
        model = ExactFill(numbers=["a", "b"], texts=["t"]).fit(t)
        assert model.getOrDefault("medians") == [0.0, 0.0] and model.getOrDefault("modes") == [NONE]
        assert [tuple(r)[1:4] for r in model.transform(nulls).collect()] == [(0.0, 0.0, NONE)]
    assert ExactFill().fit(table).transform(table).count() == len(ROWS)


@pytest.mark.parametrize("numbers,texts", [(["zz"], []), (["a", "a"], []), (["a"], ["a"])])
def test_wrong_columns_are_refused(table, numbers, texts):
    with pytest.raises(ValueError):
        ExactFill(numbers=numbers, texts=texts).fit(table)
