"""Degenerate inputs give NULLs or empty results, never ANSI arithmetic errors."""
from pyspark.sql import functions as F

from cohortlens.operators import alerts as A
from cohortlens.operators import stats as S
from cohortlens.operators import tracking as TR
from cohortlens.roles import Roles

R = Roles(id="id", target="G3", periods=("G1", "G2", "G3"), failures="failures", absences="absences")


def test_one_group_anova_and_one_row_welch_group(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, y double")
    assert S.anova(one, "g", "y").first().f is None
    w = S.welch(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, y double"), "g", "y").first()
    assert w.df is None and w.t is None


def test_two_point_regression_has_no_t(spark):
    r = S.ols(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double"), "x", "y").first()
    assert r.slope == 2.0 and r.t is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, absences double, failures int, G1 double, G2 double, G3 double")
    e = empty.withColumns({"grade_trend": F.lit(0.0), "at_risk": F.lit(0)})
    assert [r.rule_id for r in A.alert_rules(e, R).collect()] == ["all_clear"]
    assert A.combined_risk(empty, R, median_absences=0.0).count() == 0
    snaps = spark.createDataFrame([(1, 10.0, None)], "id long, predicted double, actual double")
    s = TR.validation_summary(snaps).first()
    assert s.n_validated == 0 and s.mae is None and s.rmse is None
