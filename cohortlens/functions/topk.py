"""Most frequent values as combinable aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modes(df: DataFrame, cols) -> dict:
    """Most frequent non-null value of each column (lowest value on ties).

    Counting is a combinable group-by on (column, value) and the winner a
    combinable `min_by` per column, so a column with billions of distinct
    values is never held in one task (unlike a single `mode()` aggregate
    buffer).  Only one row per column reaches the driver.
    """
    cols = list(cols)
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*").filter(F.col("value").isNotNull())
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # min_by is a combinable aggregate: each map task keeps one candidate per column,
    # ordered by (-count, value) so ties go to the lowest value
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    got = {r["column"]: r["value"] for r in best.collect()}
    return {c: got.get(c) for c in cols}
