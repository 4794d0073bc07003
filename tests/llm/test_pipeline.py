import importlib

import duckdb

import __spark_entry__ as E
import corpus_pipeline
from cohortlens.llm import jaccard_join, quality_qda, stages, toxicity_gbt
from cohortlens.llm.common import table
from pyspark.sql import functions as F
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute
from tests.llm.test_packing import check
from tools.check_oracle import canon

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "packing"]


def test_the_rest_works_without_these_parts(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "cohortlens.llm" else real(name, *a))
    assert not any(n.startswith("op1_") or n == "pipeline" for n in E.queries())


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("op1_pivot_topk", "op9_jaccard_join"):
        df, rel = E.queries()[name](spark, SF), con.sql(E.oracle_sql()[name])
        assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())


def test_run_equals_the_operators_one_by_one(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    stats = quality_qda.document_stats(docs)
    model = quality_qda.fit(quality_qda.labelled(stats, labels, "quality", 5, 0))
    good = [r[0] for r in stats.where(quality_qda.score_column(model, F.col("stats")) >= 0.3).select("doc_id").collect()]
    kept = docs.where(F.col("doc_id").isin(good))
    clean = toxicity_gbt.fit(kept, labels).score(kept).where("score < 0.3").select("doc_id", "text").collect()
    stay = {i: t for i, t in clean if any(i == a == c for a, _, c in brute([tuple(r) for r in clean])) or not (t or "").split()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(stay) and 0 < len(stay) < 200
    from cohortlens.llm.vector_packing import Limits

    check(rows, stay, Limits())


def test_stages_keep_columns_and_odd_rows(documents, spark):
    rows = [(k, prose(k, 60)) for k in range(12)] + [(20, prose(1, 60)), (21, None), (22, ""), (None, prose(1, 60)), (3, prose(3, 60))]
    docs = documents(rows, extra=True)
    for stage in (stages.quality, stages.toxicity):
        out = stage(spark, docs, SMALL)  # labels of other documents: still a table with the same columns
        assert out.columns == docs.columns
    out = stages.near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([*range(12), 21, 22, None], key=str)
    empty = documents([])
    assert stages.near_duplicates(spark, empty, SMALL).count() == 0 and stages.quality(spark, empty, SMALL).count() == 0
    assert stages.toxicity(spark, empty, SMALL).count() == 0 and stages.packing(spark, empty, SMALL).count() == 0


def test_hidden_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2)], "doc_id long, text string, _keep int, _nth int")
    assert stages.near_duplicates(spark, df, SMALL).collect()[0].asDict() == {"doc_id": 1, "text": "a b c d e f", "_keep": 1, "_nth": 2}
    assert jaccard_join.jaccard_components(df).collect()[0]["n_shingles"] == 2


def test_each_text_of_an_id_stands_for_itself(documents, spark):
    one, two, three = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(5, one), (5, two), (5, two), (6, one + " end"), (4, three), (7, two), (8, None), (8, "")]
    out = stages.near_duplicates(spark, documents(rows), SMALL).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == sorted([(5, one), (5, two), (4, three), (8, "")])


def test_very_long_texts_pass_every_stage(documents, spark):
    rows = [(1, prose(1, 40_000)), (2, prose(1, 40_000)), (3, "x" * 300_000), (4, "word " * 60_000)]
    docs = documents(rows)
    kept = stages.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]
    for stage in (stages.quality, stages.toxicity):
        assert {r["doc_id"] for r in stage(spark, docs, SMALL).collect()} <= {1, 2, 3, 4}
    assert {r["doc_id"] for r in stages.packing(spark, docs, SMALL).select("doc_id").distinct().collect()} == {1, 2, 3, 4}
