"""The operators as filters over a documents table: every stage keeps all columns of its input rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard_join, quality_qda, toxicity_gbt, vector_packing
from .common import materialise, ship, table, text_or_empty
from .queries import BYTE_BPE, THRESHOLD


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold; the rest go.

    Rows are judged one by one: null ids, repeated rows and ties stay or go by their own score; a null text counts
    as empty; without labels of both kinds every score is the share of label 1; an empty table gives no rows.
    """
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    # only labelled rows are read for learning; their statistics are narrow and read twice
    stats = materialise(quality_qda.document_stats(docs.select("doc_id", "text")).join(known, F.col("doc_id") == F.col("_id"), "left_semi"), "quality-stats")
    model = quality_qda.fit(quality_qda.labelled(stats, labels, "quality", folds=5, held_out=0))
    score = quality_qda.score_column(model, quality_qda.stats_column(text_or_empty("text")))
    return _where(docs, score >= THRESHOLD)


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the rest go.

    Rows are judged one by one: null ids, repeated rows and ties stay or go by their own score; a null text counts
    as empty; an empty table gives no rows.
    """
    ship(spark)
    model = toxicity_gbt.fit(docs, table(spark, sf_dir, "labels"), folds=4, held_out=2)
    name = _free("score", docs)
    return model.score(docs, out=name).where(F.col(name) < THRESHOLD).drop(name)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the smallest by (id, hash of the text); the first of rows equal in both.

    Documents are told apart by id and text, so that each of several texts of an id stands for itself.
    Rows with a null id belong to no component and stay; a null text is the empty text, a component of its own.
    """
    ship(spark)
    known = F.col("doc_id").isNotNull()
    own = F.struct(F.col("doc_id"), F.xxhash64(text_or_empty("text")).alias("text_hash"))
    key = _free("_key", docs)
    groups = materialise(jaccard_join.jaccard_components(docs.where(known).select(own.alias("key"), "text"), id_col="key"), "groups")
    stay = groups.where("component_id = key").select(F.col("key").alias("_stays")).distinct()
    kept = docs.where(known).withColumn(key, own).join(stay, F.col(key) == F.col("_stays"), "left_semi")
    nth = _free("_nth", docs)
    first = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = kept.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth, key)
    return kept.union(docs.where(~known))


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences; a null text is empty, null ids and repeated rows are packed too,
    and an empty table gives no rows."""
    ship(spark)
    return vector_packing.pack(docs, **BYTE_BPE)


def _free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _where(docs: DataFrame, keep) -> DataFrame:
    flag = _free("_keep", docs)
    return docs.withColumn(flag, keep).where(F.col(flag)).drop(flag)
