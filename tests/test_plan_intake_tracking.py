"""Greedy plan vs a plain Python loop; intake validation (F10, F11); tracking (F13); streaming intake."""
import os
import tempfile
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import tracking as TR
from cohortlens.operators import whatif as W
from cohortlens.roles import Roles
from cohortlens.sources import intake as IN

R = Roles(id="id", target="g3", failures="failures", effort="effort", absences="absences",
          levers=(("effort", 1.0, 4.0, 1.0, 1), ("absences", 0.0, 93.0, 1.0, -1)))
SC = W.LinearScorer(("effort", "absences"), Decimal("6.5"), (Decimal("0.75"), Decimal("-0.125")))


def py_pred(e, a):
    v = Decimal("6.5") + Decimal("0.75") * Decimal(str(e)) + Decimal("-0.125") * Decimal(str(a))
    v = min(max(v, Decimal(0)), Decimal(20))
    return v.quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)


def py_plan(e, a, target):
    p, n = py_pred(e, a), 0
    for _ in range(80):
        if p >= Decimal(str(target)):
            break
        cands = []
        if e < 4:
            cands.append((py_pred(e + 1, a) - p, 0))
        if a > 0:
            cands.append((py_pred(e, a - 1) - p, 1))
        cands = [c for c in cands if c[0] > 0]
        if not cands:
            break
        g, k = max(cands, key=lambda c: (c[0], -c[1]))
        e, a = (e + 1, a) if k == 0 else (e, a - 1)
        p, n = p + g, n + 1
    return float(p), n, e, a


def test_greedy_plan_matches_python_loop(spark):
    rows = [(i, float(e), float(a), f) for i, (e, a, f) in enumerate(
        [(1, 0, 0), (1, 30, 1), (2, 12, 0), (4, 80, 2), (3, 3, 0), (1, 93, 0), (4, 0, 1)])]
    df = spark.createDataFrame(rows, "id long, effort double, absences double, failures int")
    got = {r.id: r for r in W.greedy_plan(df, R, SC, "id", 12.0).collect()}
    for i, e, a, _ in rows:
        p, n, e2, a2 = py_plan(e, a, 12.0)
        g = got[i]
        assert (g.final_pred, g.steps, g.effort_final, g.absences_final) == (pytest.approx(p), n, e2, a2)


def test_quick_wins_and_explain(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0), (2, 4.0, 0.0)], "id long, effort double, absences double")
    q = W.quick_wins(df, R, SC, "id").collect()
    assert [(r.id, r.lever) for r in q] == [(1, "effort"), (1, "absences")]
    ex = W.explain(df, SC, "id", {"effort": 2.0, "absences": 5.0}).collect()
    assert all(abs(r.impact) >= 0.05 for r in ex)


def test_name_dedupe_and_sniff():
    assert IN.dedupe_names(["Total", "Total", "Total", "Regiao"]) == ["Total", "Total_1", "Total_2", "Regiao"]
    assert IN.sniff_delimiter(["a;b;c", "1;2;3"]) == ";" and IN.sniff_delimiter(['"a,b";c', '"1,2";3']) == ";"
    assert IN.header_key("Tempo Livre (1-5)") == "tempo livre"
    roles, dupes = IN.detect_roles(["Idade", "age", "Faltas"], {"age": ["idade"], "absences": ["faltas"]})
    assert roles == {"Idade": "age", "Faltas": "absences"} and dupes == ["age"]


def test_bulk_validation_lines(spark):
    path = os.path.join(tempfile.mkdtemp(), "in.csv")
    with open(path, "w", encoding="utf-8-sig") as fh:
        fh.write("school;sex;age;absences\nGP;F;16;2\nXX;F;16;2\nGP;m;40;2\nGP;F;abc;2\n")
    df = IN.with_line_numbers(IN.read_upload(spark, path))
    v = IN.validate_rows(df, {"age": (15, 22), "absences": (0, 93)}, {"school": ("GP", "MS"), "sex": ("F", "M")})
    got = {r.line: (r.valid, list(r.errors)) for r in v.collect()}
    assert got[2] == (True, [])
    assert got[3] == (False, ["bad_value:school"])
    assert got[4] == (False, ["out_of_range:age"])
    assert got[5] == (False, ["not_a_number:age"])


def test_type_inference_traps(spark):
    df = spark.createDataFrame([("1", "1", "5d"), ("2", "x", "Infinity"), ("3", "3", "")], "a string, b string, c string")
    got = {r.column_name: r.inferred for r in IN.infer_types(df).collect()}
    assert got == {"a": "numeric", "b": "text", "c": "text"}


def test_snapshot_status_and_actuals(spark):
    snaps = spark.createDataFrame([(1, 10.0, 11.0), (2, 10.0, 9.0), (3, 10.0, 10.5), (4, 10.0, None)],
                                  "id long, predicted double, actual double")
    st = {r.id: r.status for r in TR.snapshot_status(snaps).collect()}
    assert st == {1: "better", 2: "worse", 3: "as_predicted", 4: "pending"}
    snaps2 = snaps.withColumn("recorded_at", F.lit(None).cast("timestamp"))
    acts = spark.createDataFrame([(4, 12.0), (9, 5.0), (3, 25.0)], "id long, actual double") \
        .withColumn("recorded_at", F.current_timestamp())
    upd, rej = TR.record_actuals(snaps2, acts)
    assert {r.id: r.reason for r in rej.collect()} == {9: "unknown_id", 3: "out_of_range"}
    assert upd.filter("id = 4").first().actual == 12.0
    s = TR.validation_summary(snaps).first()
    assert s.n_validated == 3 and s.mae == pytest.approx(0.83)


def test_streaming_bulk_intake(spark):
    from cohortlens.streaming.intake_stream import start_bulk_intake
    base = tempfile.mkdtemp()
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    os.makedirs(src)
    for k, body in enumerate(["age,absences\n16,2\n99,1\n", "age,absences\nx,3\n17,0\n"]):
        with open(os.path.join(src, f"f{k}.csv"), "w") as fh:
            fh.write(body)
    q = start_bulk_intake(spark, src, out, ["age", "absences"], {"age": (15, 22), "absences": (0, 93)}, {},
                          name=f"t{os.getpid()}")
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(out, "added")).count() == 2
    assert spark.read.parquet(os.path.join(out, "rejected")).count() == 2


def test_new_snapshots_and_recent_order(spark):
    preds = spark.createDataFrame([({"studytime": "3"}, 12.5, "habits"), ({}, 9.0, "full")],
                                  "habits map<string,string>, predicted double, variant string")
    s = TR.new_snapshots(preds, "trial")
    rows = s.collect()
    assert len({r.id for r in rows}) == 2 and all(r.actual is None for r in rows)
    assert TR.most_recent_first(s).count() == 2


def test_score_with_rejects(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression
    from cohortlens.operators import models as M
    train = spark.createDataFrame([(i, float(i % 4), float(i % 7), 5.0 + i % 4) for i in range(40)],
                                  "id long, a double, b double, y double")
    model = Pipeline(stages=M.preprocessor(["a", "b"], []) + [LinearRegression(labelCol="y")]).fit(train)
    req = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0)], "id long, a double, b double")
    ok, rej = M.score_with_rejects(model, req, ["a", "b"])
    assert [r.id for r in ok.collect()] == [1] and rej.first().missing == "a"


def test_bulk_intake_end_to_end(spark):
    df = spark.createDataFrame([("3", "2"), ("9", "1"), ("x", "0"), ("", "4")], "effort string, absences string")
    out = os.path.join(tempfile.mkdtemp(), "added")
    counts = IN.bulk_intake(df, {"effort": (1, 4), "absences": (0, 93)}, {}, [], {"effort": 2, "absences": 3},
                            SC, "g3", out)
    assert counts == {"added": 2, "rejected": 2}
    rows = spark.read.parquet(out).orderBy("absences").collect()
    assert [(r.effort, r.label_source) for r in rows] == [(3, "imputed"), (2, "imputed")]
    assert all(r.g3 is not None for r in rows)
    assert spark.read.parquet(out + "_rejected").count() == 2


def test_upload_quotes_breaks_and_repeated_headers(spark):
    path = os.path.join(tempfile.mkdtemp(), "in.csv")
    with open(path, "w", encoding="utf-8-sig") as fh:
        fh.write('a;a;text\n1;2;"say ""hi""; you"\n3;4;"two\nlines"\n')
    rows = IN.read_upload(spark, path, multi_line=True).collect()
    assert [r.asDict() for r in rows] == [{"a": "1", "a_1": "2", "text": 'say "hi"; you'}, {"a": "3", "a_1": "4", "text": "two\nlines"}]


def test_upload_folder_with_other_delimiter_is_an_error(spark):
    folder = tempfile.mkdtemp()
    for name, text in (("1.csv", "a,b\n1,2\n"), ("2.csv", "a;b\n3;4\n")):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        IN.read_upload(spark, folder).collect()


def test_line_numbers_over_partitions(spark):
    path = os.path.join(tempfile.mkdtemp(), "in.csv")
    with open(path, "w") as fh:
        fh.write("n\n" + "".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = IN.with_line_numbers(IN.read_upload(spark, path))
        assert df.where("line != cast(n as long) + 2").count() == 0 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_header_folding_on_data_equals_names(spark):
    names = ["Tempo Livre (1-5)", "Média__final!", "  A  b ", "(x)", "Ação/Ñandú 2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(IN.fold_header(df["n"])).collect()] == [IN.header_key(n) for n in names] == \
        ["tempo livre", "media final", "a b", "", "acao nandu 2"]


def test_suggestion_without_known_field_and_with_missing_values(spark):
    from cohortlens.operators import suggest as SU
    df = spark.createDataFrame([(i, float(i), "a" if i < 60 else "b") for i in range(100)] + [(100, None, "c")], "k long, x double, s string")
    out, near = SU.suggest(df, "k", {}, ["x"], ["s"])
    assert {r.field: r.value for r in out.collect()} == {"x": "50", "s": "a"} and near.count() == 0
    _, near = SU.suggest(df, "k", {"x": 50}, ["x"], ["s"])
    assert near.first()["k"] == 50 and 100 not in {r.k for r in near.collect()}


def test_very_long_number_in_a_question(spark):
    from cohortlens.operators import questions as QU
    df = spark.createDataFrame([(1, "student 99999999999999999999"), (2, "student 12")], "k long, text string")
    assert {r.k: r.subject_id for r in QU.route(df, "text", ["k"]).collect()} == {1: None, 2: 12}
