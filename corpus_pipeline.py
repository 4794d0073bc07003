"""A corpus cleaned and packed for training: each stage's rows are written as Parquet and read by the next.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and gives a DataFrame,
with the columns of documents from every stage but the last.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import stages
from cohortlens.llm.common import materialise, table

STAGES = [
    ("quality_classifier", stages.quality),
    ("toxicity", stages.toxicity),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("packing", stages.packing),
]

#: The classifiers and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = materialise(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
