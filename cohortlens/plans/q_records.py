"""Registered jobs for tables that grow: added rows, actual results, writes, names, class counts
(O-02, O-05, O-08, O-23, O-33, O-36, O-55, O-66, O-67, O-93, O-118)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, explore
from ..operators import tracking as TR
from ..operators import whatif as W
from ..roles import SUBJECTS as R
from ..session import scratch_path
from ..sources import intake as IN
from ..sources.tables import read, write_table
from .bindings import SNAPSHOTS_SQL, snapshots
from .curated import curated
from .oracle import with_curated
from .registry import register, rounded

_SNAP = f"WITH snap AS ({SNAPSHOTS_SQL})"


@register("class_counts", with_curated("SELECT passed, COUNT(*) AS n FROM curated GROUP BY passed"))
def q_class_counts(spark, sf_dir):
    return explore.class_counts(curated(spark, sf_dir), "passed")


@register("union_added_rows", with_curated("""
SELECT label_source, COUNT(*) AS n, ROUND(SUM(g3), 6) AS total FROM (
  SELECT g3, 'observed' AS label_source FROM curated
  UNION ALL SELECT g3, 'imputed' FROM curated WHERE subject_id % 10 = 0) GROUP BY label_source"""))
def q_union_added(spark, sf_dir):
    """O-23: added rows without a marker count as imputed."""
    df = curated(spark, sf_dir)
    both = clean.union_added(df, df.filter(F.col("subject_id") % 10 == 0))
    return rounded(both.groupBy("label_source").agg(F.count(F.lit(1)).alias("n"), F.sum("g3").alias("total")))


@register("defaults_attached", with_curated("""
, m AS (SELECT quantile_cont(effort, 0.5) AS effort, quantile_cont(absences, 0.5) AS absences FROM curated),
r AS (SELECT subject_id, CASE WHEN subject_id % 3 <> 0 THEN effort END AS effort,
             CASE WHEN subject_id % 3 <> 1 THEN absences END AS absences FROM curated)
SELECT subject_id, ROUND(CAST(COALESCE(r.effort, m.effort) AS DOUBLE), 6) AS effort,
       ROUND(CAST(COALESCE(r.absences, m.absences) AS DOUBLE), 6) AS absences FROM r, m"""))
def q_defaults_attached(spark, sf_dir):
    """O-36: requests with missing fields get the typical values."""
    df = curated(spark, sf_dir)
    typical = explore.defaults(df, R, numeric=["effort", "absences"], categorical=[]).first().asDict()
    sparse = df.select("subject_id", F.when(F.col("subject_id") % 3 != 0, F.col("effort").cast("double")).alias("effort"),
                       F.when(F.col("subject_id") % 3 != 1, F.col("absences").cast("double")).alias("absences"))
    return rounded(W.fill_defaults(sparse, {c: typical[c] for c in ("effort", "absences")}))


def _requests(spark, sf_dir):
    """Actual results to record: for every event with an even id a value that may be out of range, for odd ones an unknown id."""
    s = snapshots(spark, sf_dir)
    return s.select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).alias("id"),
                    (F.col("predicted") + F.col("id") % 7 - 1).alias("actual"), F.col("created_at").alias("recorded_at"))


_REQUESTS = ", req AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE -id END AS id, predicted + id % 7 - 1 AS actual, created_at AS recorded_at FROM snap)"


@register("record_actuals", _SNAP + _REQUESTS + """
SELECT s.id, ROUND(COALESCE(r.actual, s.actual), 6) AS actual, COALESCE(r.recorded_at, s.recorded_at) AS recorded_at
FROM snap s LEFT JOIN (SELECT * FROM req WHERE actual BETWEEN 0 AND 20) r ON r.id = s.id""")
def q_record_actuals(spark, sf_dir):
    """O-33: actual results attached by id."""
    updated, _ = TR.record_actuals(snapshots(spark, sf_dir), _requests(spark, sf_dir))
    return rounded(updated.select("id", "actual", "recorded_at"))


@register("record_actuals_rejects", _SNAP + _REQUESTS + """
SELECT id, CASE WHEN id NOT IN (SELECT id FROM snap) THEN 'unknown_id' ELSE 'out_of_range' END AS reason
FROM req WHERE id NOT IN (SELECT id FROM snap) OR NOT actual BETWEEN 0 AND 20""")
def q_record_rejects(spark, sf_dir):
    _, rejected = TR.record_actuals(snapshots(spark, sf_dir), _requests(spark, sf_dir))
    return rejected.select("id", "reason")


@register("most_recent", _SNAP + " SELECT id, created_at FROM snap ORDER BY created_at DESC, id DESC LIMIT 50")
def q_most_recent(spark, sf_dir):
    """O-66: a report of the 50 newest snapshots."""
    return TR.most_recent_first(snapshots(spark, sf_dir)).select("id", "created_at").limit(50)


@register("write_append_read", with_curated(
    "SELECT subject_id, g3, COUNT(*) AS n FROM (SELECT subject_id, g3 FROM curated UNION ALL "
    "SELECT subject_id, g3 FROM curated WHERE passed = 0) GROUP BY subject_id, g3"))
def q_write_append(spark, sf_dir):
    """O-05, O-08, O-67: replaced, appended to and read back, with the source's keys."""
    df, path = curated(spark, sf_dir).select("subject_id", "g3", "passed"), scratch_path(spark, "table")
    write_table(df.limit(1), path)
    write_table(df, path)
    write_table(df.filter("passed = 0"), path, mode="append")
    return spark.read.schema(df.schema).parquet(path).groupBy("subject_id", "g3").agg(F.count(F.lit(1)).alias("n"))


@register("header_folding", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS folded
FROM documents""")
def q_header_folding(spark, sf_dir):
    """O-118 on data: the folded form of every whole text, as its digest."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(IN.fold_header(F.col("text"))).alias("folded"))


_UPLOAD = ["id", "note", "note_1"]


@register("upload_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS note, 'say "' || lang || '"; ' || source AS note_1 FROM documents""")
def q_upload(spark, sf_dir):
    """O-07: texts with quotes, separators, line breaks and a repeated header, written as CSV and read as an upload."""
    d = read(spark, sf_dir, "documents")
    path = scratch_path(spark, "upload")
    quoted = F.concat(F.lit('say "'), "lang", F.lit('"; '), "source")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("<"), "text", F.lit(">")).alias("note"), quoted.alias("note_1"))
    lines = rows.select(F.array_join(F.array(*[F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in _UPLOAD]), ";").alias("value"))
    # the writer's own header would have unique names: the header goes in front of each partition's first row
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines.select(F.when(at == 0, F.concat(F.lit("id;note;note\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)
    back = IN.read_upload(spark, path, multi_line=True)
    return back.select("id", F.md5(F.expr("substring(note, 2, length(note) - 2)")).alias("note"), "note_1")
