"""Invariants on the driver tables and the streaming validation summary."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranks as K
from cohortlens.operators import segment as SG
from cohortlens.operators import whatif as W
from cohortlens.plans.bindings import snapshots
from cohortlens.plans.curated import curated
from cohortlens.roles import SUBJECTS as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cur(spark):
    return curated(spark, SF)


def test_segments_partition_the_ids(spark, cur):
    a, summary, _ = SG.segment(cur, R, ["effort", "absences", "failures", "n_orders"], k=4)
    assert a.count() == cur.count() == a.select("subject_id").distinct().count()
    assert summary.agg(F.sum("size")).first()[0] == cur.count()
    means = [r.mean_target for r in summary.orderBy("group").collect()]
    assert means == sorted(means, reverse=True)


def test_k_is_clamped_and_two_features_required(spark, cur):
    a, _, _ = SG.segment(cur, R, ["effort", "absences"], k=50)
    assert a.select("group").distinct().count() <= 8
    with pytest.raises(ValueError):
        SG.segment(cur, R, ["effort"], k=4)
    with pytest.raises(ValueError, match="nonsense"):
        SG.segment(cur, R, ["effort", "absences", "nonsense"], k=4)


def test_percentile_ranks_are_monotone(spark, cur):
    pr = K.percentile_rank(cur, "subject_id", ["g3"]).join(cur.select("subject_id", "g3"), "subject_id")
    rows = sorted((r.g3, r.pct_g3) for r in pr.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert 0 < rows[0][1] and rows[-1][1] <= 100


def test_plan_levers_stay_within_bounds(spark, cur):
    sc = W.LinearScorer.fit(cur, ("effort", "absences"), "g3")
    p = W.greedy_plan(cur, R, sc, "subject_id", 15.0).collect()
    assert all(1 <= r.effort_final <= 4 and 0 <= r.absences_final <= 93 for r in p)
    assert all(r.steps <= 80 for r in p)
    assert all(r.effort_change >= 0 and r.absences_change <= 0 for r in p)


def test_streaming_validation_summary_matches_batch(spark):
    from cohortlens.operators import tracking as TR
    from cohortlens.streaming.intake_stream import validation_stream
    snaps = snapshots(spark, SF).select("label", "predicted", "actual")
    src = os.path.join(tempfile.mkdtemp(), "snaps")
    snaps.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(snaps.schema).parquet(src)
    q = (validation_stream(stream).writeStream.outputMode("complete").format("memory")
         .queryName("vstream_test").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("vstream_test").agg(F.sum("n_validated"), F.sum("sum_cents")).first()
    exp = TR.validation_summary(snapshots(spark, SF)).first()
    assert got[0] == exp.n_validated
