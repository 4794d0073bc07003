"""Retry-safe intake: repeats, lost jobs, ids and odd uploads."""
from datetime import datetime
from decimal import Decimal

import pytest

from cohortlens.operators.whatif import LinearScorer
from cohortlens.sources import batches as B

SCORER = LinearScorer(("effort", "absences"), Decimal("6.5"), (Decimal("0.75"), Decimal("-0.125")))
SCHEMA = "effort string, absences string, note string"
ROWS = [("3", "2", "b"), ("9", "1", None), ("x", "0", "c"), ("", "4", "a"), ("3", "2", "b"), (None, None, None)]
AT = datetime(2026, 1, 2)


def _take(df, out, **kw):
    return B.intake_batch(df, {"effort": (1, 4), "absences": (0, 93)}, {}, ["note"], {"effort": 2, "absences": 3}, SCORER, "g3", out, at=AT, **kw)


def _all(spark, out):
    return {t: sorted(map(repr, B.read_batches(spark, out, t).collect())) for t in B.TABLES}


def test_a_repeat_in_any_order_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    first = _take(spark.createDataFrame(ROWS, SCHEMA), out)
    assert (first["added"], first["rejected"]) == (4, 2)
    before = _all(spark, out)
    assert _take(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(3), out) == first and _all(spark, out) == before
    added = B.read_batches(spark, out, "added").collect()
    assert sorted((r["effort"], r["absences"], r["g3"]) for r in added) == [(2, 3, 7.62), (2, 4, 7.5), (3, 2, 8.5), (3, 2, 8.5)]
    ids = {r["id"] for t in ("added", "rejected") for r in B.read_batches(spark, out, t).collect()}
    assert ids == {f"{first['batch']}-{n}" for n in range(1, 7)}
    snaps = B.read_batches(spark, out, "snapshots").collect()
    assert {(s["id"], s["predicted"]) for s in snaps} == {(r["id"], r["g3"]) for r in added}
    assert all(s["actual"] is None and s["created_at"] == AT for s in snaps)


def test_a_lost_job_shows_nothing_and_its_repeat_gives_the_same(spark, tmp_path, monkeypatch):
    df, out, plain = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "t"), str(tmp_path / "plain")
    _take(df, plain, batch="b1"), _take(df, plain, batch="b2")
    _take(df, out, batch="b1")
    write = B._write

    def lost(rows, folder, table, batch):
        if table == "snapshots":
            raise RuntimeError("lost")
        write(rows, folder, table, batch)

    monkeypatch.setattr(B, "_write", lost)
    with pytest.raises(RuntimeError):
        _take(df, out, batch="b2")
    monkeypatch.undo()
    assert {r["batch"] for t in B.TABLES for r in B.read_batches(spark, out, t).collect()} == {"b1"}
    _take(df, out, batch="b2")
    assert _all(spark, out) == _all(spark, plain)
    assert sorted(map(tuple, B.finished_batches(spark, out).collect())) == [("b1", 4, 2), ("b2", 4, 2)]


def test_content_key_knows_every_value(spark):
    key = lambda rows: B.content_key(spark.createDataFrame(rows, SCHEMA))
    keys = [key(r) for r in (ROWS, ROWS[1:], ROWS + ROWS[:1], [("3", "2", "")], [("3", "2", None)], [("3", "2", "-")], [])]
    assert len(set(keys)) == len(keys) and key(ROWS[::-1]) == keys[0]


def test_odd_uploads(spark, tmp_path):
    out = str(tmp_path / "t")
    assert _take(spark.createDataFrame([], SCHEMA), out, batch="007") == {"batch": "007", "added": 0, "rejected": 0}
    assert B.read_batches(spark, out, "added").count() == 0
    assert B.finished_batches(spark, out).first()["batch"] == "007"
    df = spark.createDataFrame(ROWS, SCHEMA)
    for bad in ("a/b", "", "a b"):
        with pytest.raises(ValueError):
            _take(df, out, batch=bad)
    with pytest.raises(ValueError):
        _take(df.withColumnRenamed("note", "id"), out)
    with pytest.raises(ValueError):
        B.read_batches(spark, out, "other")
