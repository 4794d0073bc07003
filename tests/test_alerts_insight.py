"""Alerts, combined risk, unusual values (FIXTURES F4, F14)."""
from cohortlens.operators import alerts as A
from cohortlens.roles import Roles

R = Roles(id="id", target="G3", periods=("G1", "G2", "G3"), failures="failures", absences="absences")


def frame(spark, absences, failures, g3=None):
    g3 = g3 or [12] * len(absences)
    rows = [(i, float(a), f, float(g), float(g), float(g)) for i, (a, f, g) in enumerate(zip(absences, failures, g3))]
    return spark.createDataFrame(rows, "id long, absences double, failures int, G1 double, G2 double, G3 double")


def test_combined_risk_absent(spark):
    assert A.combined_risk(frame(spark, [1, 2, 2, 3, 4], [0, 0, 1, 0, 0]), R).count() == 0


def test_combined_risk_fires(spark):
    r = A.combined_risk(frame(spark, [0, 1, 2, 8, 9, 10], [0, 0, 0, 1, 2, 1]), R).first()
    assert r.n_combined == 3


def test_combined_risk_severity_by_share(spark):
    w = A.combined_risk(frame(spark, [1] * 95 + [9, 9], [0] * 95 + [1, 1]), R).first()
    u = A.combined_risk(frame(spark, [1] * 80 + [9] * 20, [0] * 80 + [1] * 20), R).first()
    assert (w.severity, u.severity) == ("warning", "urgent")


def test_alert_rules_sorted_and_all_clear(spark):
    from pyspark.sql import functions as F
    base = frame(spark, [1, 2, 3, 50], [0, 0, 0, 2], [12, 12, 12, 5]).withColumns(
        {"grade_trend": F.lit(-1.0), "at_risk": F.when(F.col("G3") < 10, 1).otherwise(0)})
    rules = A.alert_rules(base, R, risk_rate_threshold=0.2).collect()
    sev = [r.severity_rank for r in rules]
    assert sev == sorted(sev) and rules[0].rule_id == "risk_rate_high"
    calm = frame(spark, [1, 1, 1], [0, 0, 0]).withColumns({"grade_trend": F.lit(1.0), "at_risk": F.lit(0)})
    assert [r.rule_id for r in A.alert_rules(calm, R).collect()] == ["all_clear"]


def test_unusual_values_cases(spark):
    rows = [(i, 2.0, 0, 10.0, 11.0, 11.0) for i in range(40)]
    rows += [(100, 60.0, 0, 10.0, 10.0, 10.0), (101, 2.0, 0, 5.0, 18.0, 12.0), (102, 2.0, 3, 17.0, 18.0, 15.0),
             (103, 2.0, 3, 8.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, absences double, failures int, G1 double, G2 double, G3 double")
    got = {(r.id, r.code) for r in A.unusual_values(df, R, ["absences"], "id").collect()}
    assert (100, "much_higher") in got
    assert (101, "jump_up") in got
    assert (102, "many_failures_high_grades") in got
    assert not any(i == 103 for i, _ in got)


def test_heavy_use_rule_limits(spark):
    from pyspark.sql import functions as F
    base = frame(spark, [1, 1, 1, 1, 1], [0] * 5, [9, 10, 9, 9, 9]).withColumns({"grade_trend": F.lit(1.0), "at_risk": F.lit(0)})
    level = F.element_at(F.array(*[F.lit(x).cast("double") for x in (3.0, 5.0, 2.9, None, 4.0)]), (F.col("id") + 1).cast("int"))
    rules = A.alert_rules(base.withColumn("load", level), R, heavy_use="load").collect()
    assert [(r.rule_id, r.severity, r.n, r.value) for r in rules] == [("heavy_use_low_target", "info", 2, 3.0)]
    assert [r.rule_id for r in A.alert_rules(base, R, heavy_use="absent").collect()] == ["all_clear"]


def test_heavy_use_recommendation_limit(spark):
    from dataclasses import replace

    from cohortlens.operators import insight as I
    rows = [(1, 3, 0, 1.0, 12.0, 2.0), (2, 4, 0, 1.0, 11.0, 2.1), (3, 3, 0, 1.0, 10.0, None)]
    df = spark.createDataFrame(rows, "id long, effort int, failures int, absences double, G3 double, load double")
    got = I.recommendations(df, replace(R, effort="effort"), heavy_use="load").collect()
    assert {r.id: r.codes for r in got} == {1: "", 2: "reduce_heavy_use", 3: ""}


def test_added_rows_and_report_tables(spark, tmp_path):
    from cohortlens.sources.tables import read_table_or_empty, write_report
    none = read_table_or_empty(spark, "no_such_added_rows", "id long, name string")
    assert none.count() == 0 and none.columns == ["id", "name"]
    spark.createDataFrame([(1, "a")], "id long, name string").createOrReplaceTempView("added_rows_view")
    assert read_table_or_empty(spark, "added_rows_view", none.schema).collect() == [(1, "a")]
    metrics = spark.createDataFrame([("mae", 1.5), ("r2", 0.25)], "metric string, value double")
    for fmt in ("json", "parquet"):
        for _ in range(2):  # a second report replaces the first
            write_report(metrics, str(tmp_path / fmt), fmt)
        back = spark.read.schema(metrics.schema).format(fmt).load(str(tmp_path / fmt))
        assert sorted(back.collect()) == [("mae", 1.5), ("r2", 0.25)]
