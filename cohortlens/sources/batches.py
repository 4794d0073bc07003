"""Retry-safe intake (O-93, O-103, O-106): added rows, rejects and snapshots of an upload under one batch key.

`<out>/added`, `<out>/rejected` and `<out>/snapshots` hold a folder for each batch, overwritten when the
batch is repeated, and `<out>/batches` a row of counts that is written last.  A batch counts only with
that row (`read_batches`), so a job that is lost half-way leaves nothing visible, its repeat starts over, and
repeating a finished batch changes nothing.

Rows get the id `<batch>-<n>`; n counts rows in the order of their raw texts, by prefix counts over
ranges.  Equal rows can be swapped without a difference, so every repeat gives the same ids.

Defined results: without a key, the batch is named by its content (an unordered digest of all
rows), so the same upload twice is one batch; equal rows inside a batch are kept, each with an id; an
empty upload is a batch with zero counts; NULLs come before texts in the order and are as missing as blanks;
extra columns go along; columns named like those written here (`RESERVED`, or the target) are an error, as
is a key with other characters than letters, digits, `_` and `-`.  One batch must not be written by two jobs
at the same time.
"""
from __future__ import annotations

import re
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import prefix_sums
from .intake import validate_rows

RESERVED = ("id", "batch", "row_no", "label_source", "valid", "errors", "predicted")
TABLES = ("added", "rejected", "snapshots")
_BATCH = "batch string, added long, rejected long"


def content_key(df: DataFrame) -> str:
    """Digest of the rows whatever their order: their count and two sums of hashes, one combinable aggregate."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in df.columns]
    digest = F.sha2(F.concat_ws("\x1f", F.lit(",".join(df.columns)), *texts), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 16)]
    return df.agg(F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *parts), 256)).first()[0][:24]


def _counts(spark: SparkSession, out: str, batch: str):
    """The row of a finished batch, else None."""
    try:
        return spark.read.schema(_BATCH).parquet(f"{out}/batches/key={batch}").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _write(df: DataFrame, out: str, table: str, batch: str) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{table}/key={batch}")


def _finish(spark: SparkSession, out: str, batch: str, added: int, rejected: int) -> None:
    row = spark.createDataFrame([(batch, added, rejected)], _BATCH).coalesce(1)
    row.write.mode("overwrite").parquet(f"{out}/batches/key={batch}")


def intake_batch(df: DataFrame, bounds, enums, extras, defaults: dict, scorer, target: str, out: str,
                 batch: str | None = None, label: str = "", at: datetime | None = None) -> dict:
    """Validate every row of `df` (texts), fill missing fields of valid rows with `defaults`, score them, store
    the prediction as an imputed target, and write rows, rejects with their error codes and snapshots of
    the predictions (`at`: their time) as one batch.  Returns its key and counts."""
    spark, out = df.sparkSession, out.rstrip("/")
    clash = sorted({*RESERVED, target} & set(df.columns))
    if clash:
        raise ValueError(f"columns that the intake writes itself: {clash}")
    batch = content_key(df) if batch is None else batch
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"batch key: {batch!r}")
    done = _counts(spark, out, batch)
    if done is None:
        from ..plans.curated import materialise

        raw = df.withColumns({f"raw_{i}": F.col(c).cast("string") for i, c in enumerate(df.columns)})
        numbered = prefix_sums(raw, [f"raw_{i}" for i in range(len(df.columns))], {"row_no": F.lit(1).cast("bigint")})
        ids = F.concat(F.lit(f"{batch}-"), F.col("row_no").cast("string"))
        checked = materialise(validate_rows(numbered.select(ids.alias("id"), "row_no", *df.columns), bounds, enums, extras), "intake")
        valid = checked.where("valid").drop("valid", "errors")
        filled = valid.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in valid.columns})
        scored = scorer.score(filled, out="predicted")
        _write(scored.withColumnRenamed("predicted", target).withColumn("label_source", F.lit("imputed")), out, "added", batch)
        _write(checked.where("NOT valid").drop("valid"), out, "rejected", batch)
        _write(scored.select("id", F.lit(label).alias("label"), "predicted", F.lit(None).cast("double").alias("actual"),
                             F.lit(None).cast("timestamp").alias("recorded_at"),
                             (F.current_timestamp() if at is None else F.lit(at)).alias("created_at")), out, "snapshots", batch)
        n = checked.agg(F.count_if("valid").alias("added"), F.count_if(~F.col("valid")).alias("rejected")).first()
        _finish(spark, out, batch, n["added"], n["rejected"])
        done = n
    return {"batch": batch, "added": done["added"], "rejected": done["rejected"]}


def finished_batches(spark: SparkSession, out: str) -> DataFrame:
    """(batch, added, rejected) of all finished batches."""
    return spark.read.schema(_BATCH).option("recursiveFileLookup", True).parquet(f"{out.rstrip('/')}/batches")


def read_batches(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of one of `TABLES`, of finished batches only."""
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{out.rstrip('/')}/{table}")
    return rows.join(finished_batches(spark, out).select("batch"), "batch", "left_semi")
