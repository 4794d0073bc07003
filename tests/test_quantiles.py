"""Bracket-and-refine quantiles against Spark's value map and numpy, and the odd cases of their docstring."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clean
from cohortlens.operators.quantiles import column_medians, column_quantiles, exact_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _by_map(df, cols, by=()):
    out = {}
    for c in cols:
        q = df.groupBy(*by).agg(F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in PROBS])).alias("q"))
        out |= {(*r[:-1], c): r["q"] for r in q.collect() if r["q"] is not None}
    return out


@pytest.mark.parametrize("bins", [16, 1024])
def test_columns_equal_the_value_map(spark, bins):
    rnd = random.Random(bins)
    rows = [(rnd.gauss(0, 1), rnd.randint(0, 6), rnd.lognormvariate(0, 4), 7.5, None if rnd.random() < 0.3 else rnd.random()) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").cache()
    got = column_quantiles(df, df.columns, PROBS, bins=bins)
    assert {(c,): got[c] for c in got} == _by_map(df, df.columns)
    assert got["a"] == pytest.approx(list(np.quantile([r[0] for r in rows], PROBS)))


def test_groups_equal_the_value_map(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["x", "y", None, "x"]), rnd.randint(1, 2), float(rnd.randint(-50, 50)), rnd.random()) for _ in range(900)]
    rows += [("alone", 1, 3.0, None), ("empty", 1, None, None)]
    df = spark.createDataFrame(rows, "field string, value int, x double, y double")  # names that clash with inner ones
    q = exact_quantiles(df.withColumnRenamed("field", "i"), ["x", "y"], PROBS, by=["i", "value"], bins=16)
    assert q.columns == ["i", "value", "field"] + [f"q{i}" for i in range(len(PROBS))]
    got = {(r["i"], r["value"], r["field"]): [r[f"q{i}"] for i in range(len(PROBS))] for r in q.collect()}
    want = {(*k[:-1], k[-1]): v for k, v in _by_map(df, ["x", "y"], ["field", "value"]).items()}
    assert got == want and ("alone", 1, "y") not in got and ("empty", 1, "x") not in got


def test_far_outliers_and_special_values(spark):
    far = [1e308, -1e308, 5e-324, 0.0, -0.0, 1.0, 1.0 + 2 ** -52, 1e-300]
    df = spark.createDataFrame([(v,) for v in far], "x double")
    ranks = [i / (len(far) - 1) for i in range(len(far))]
    assert column_quantiles(df, ["x"], ranks)["x"] == sorted(far)
    odd = spark.createDataFrame([(v,) for v in (math.inf, -math.inf, math.nan, 2.0, 1.0, None)], "x double")
    q = column_quantiles(odd, ["x"], (0.0, 0.25, 0.5, 0.75, 1.0))["x"]
    assert q[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(q[4])


def test_grouped_special_values(spark):
    odd = spark.createDataFrame([("a", v) for v in (math.inf, -math.inf, math.nan, 2.0, 1.0, None)] + [("b", 1.0)], "g string, x double")
    got = {r["g"]: list(r)[2:] for r in exact_quantiles(odd, ["x"], (0.0, 0.25, 0.5, 0.75, 1.0), by=["g"]).collect()}
    assert got["a"][:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got["a"][4]) and got["b"] == [1.0] * 5


def test_empty_tables_and_columns_without_values(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert column_medians(df, ["x"]) == {"x": None} and column_medians(df, []) == {}
    assert exact_quantiles(df, ["x"], [0.5], by=["k"]).count() == 0
    nulls = spark.createDataFrame([("a", None), ("b", None)], "k string, x double")
    assert column_medians(nulls, ["x"]) == {"x": None}
    assert clean.fit_bounds(nulls, ["x", "missing"]) == {}


def test_no_value_map_in_the_plan(spark, capsys):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x"))
    exact_quantiles(df, ["x"], [0.5], by=["g"]).explain("formatted")
    assert "percentile" not in capsys.readouterr().out
