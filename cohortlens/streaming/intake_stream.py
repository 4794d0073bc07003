"""Incremental forms of intake and tracking with Structured Streaming.

* `start_bulk_intake`: CSV files dropped into a folder are read as a stream
  (all-text schema), validated row by row (O-103) and appended — valid rows
  to the added-rows table, rejected rows with their error codes to a reject
  table (O-67).  The sink is idempotent per micro-batch id, so a restarted
  query after an executor or driver loss does not append twice.
* `validation_stream`: recorded actuals arrive as a stream; the running
  validation summary per label (O-52) is a streaming aggregation kept in the
  state store.

Checkpoints live under the shared `spark.checkpoint.dir`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import cents
from ..session import checkpoint_dir
from ..sources.intake import validate_rows


def start_bulk_intake(spark: SparkSession, in_dir: str, out_dir: str, columns, bounds, enums, extras=(),
                      sep: str = ",", name: str = "bulk_intake", available_now: bool = True):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    src = (spark.readStream.schema(schema).option("header", True).option("sep", sep)
           .option("maxFilesPerTrigger", 100).csv(in_dir)
           .withColumn("source_file", F.input_file_name()))
    checked = validate_rows(src, bounds, enums, extras)

    def sink(batch: DataFrame, epoch: int):
        # one directory per epoch: re-running an epoch overwrites, never duplicates
        b = batch.withColumn("epoch", F.lit(epoch))
        b.filter("valid").drop("valid", "errors").write.mode("overwrite").parquet(f"{out_dir}/added/epoch={epoch}")
        b.filter(~F.col("valid")).write.mode("overwrite").parquet(f"{out_dir}/rejected/epoch={epoch}")

    w = (checked.writeStream.foreachBatch(sink)
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def validation_stream(actuals: DataFrame) -> DataFrame:
    """Running per-label summary over a stream with columns (label, predicted, actual)."""
    v = actuals.filter(F.col("actual").isNotNull())
    e = F.abs(cents(F.col("actual")) - cents(F.col("predicted")))
    d = (cents(F.col("actual")) - cents(F.col("predicted"))) / 100.0
    return v.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_validated"),
        F.sum(e).alias("sum_cents"),
        F.sum(e * e).alias("sum_sq_cents"),
        F.count_if(d > 0.5).alias("n_better"),
        F.count_if(d < -0.5).alias("n_worse"),
    )
