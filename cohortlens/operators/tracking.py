"""Prediction tracking (O-33, O-52, O-58, O-66, O-106, O-107)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import cents, half_even_div
from .ranks import running_error

TOLERANCE = 0.5  # fixed value: |diff| above this is better/worse than predicted
SNAPSHOT_SCHEMA = ("id string, label string, habits map<string,string>, predicted double, variant string, "
                   "actual double, recorded_at timestamp, created_at timestamp")


def snapshot_status(df: DataFrame) -> DataFrame:
    """O-107: diff = actual - predicted (2 dp); > 0.5 better, < -0.5 worse, else as predicted; no actual → pending."""
    diff = (cents(F.col("actual")) - cents(F.col("predicted"))) / 100.0
    status = (F.when(F.col("actual").isNull(), "pending").when(diff > TOLERANCE, "better")
              .when(diff < -TOLERANCE, "worse").otherwise("as_predicted"))
    return df.withColumns({"diff": diff, "status": status})


def validation_summary(df: DataFrame) -> DataFrame:
    """O-52: n validated, MAE and RMSE (2 dp), counts per status; zero-row state has n = 0."""
    s = snapshot_status(df).filter(F.col("actual").isNotNull())
    e = F.abs(cents(F.col("actual")) - cents(F.col("predicted")))
    a = s.agg(
        F.count(F.lit(1)).alias("n_validated"),
        F.sum(e).alias("sum_cents"),
        F.sum(e * e).alias("sum_sq_cents"),
        F.count_if(F.col("status") == "better").alias("n_better"),
        F.count_if(F.col("status") == "worse").alias("n_worse"),
        F.count_if(F.col("status") == "as_predicted").alias("n_as_predicted"),
    )
    return a.select(
        "n_validated",
        F.when(F.col("n_validated") > 0, half_even_div("sum_cents", "n_validated") / 100.0).alias("mae"),
        F.when(F.col("n_validated") > 0,
               F.bround(F.sqrt(F.try_divide(F.col("sum_sq_cents"), F.col("n_validated"))) / 100.0, 2)).alias("rmse"),
        "n_better", "n_worse", "n_as_predicted",
    )


def accuracy_over_time(df: DataFrame, parts: int | None = None) -> DataFrame:
    """O-58: running MAE by record time (ties by id) over validated snapshots."""
    v = df.filter(F.col("actual").isNotNull()).select("id", "label", "predicted", "actual", "recorded_at")
    return running_error(v, ["recorded_at", "id"], "predicted", "actual", parts)


def record_actuals(snaps: DataFrame, actuals: DataFrame, lo: float = 0.0, hi: float = 20.0):
    """O-33: attach actual results by snapshot id.  Returns (updated snapshots,
    rejected requests with a reason).  Unknown ids and out-of-range values are
    rejected; the update is a rewrite of the joined table."""
    req = actuals.select(F.col("id"), F.col("actual").alias("__new"), F.col("recorded_at").alias("__at"))
    ok_range = F.col("__new").between(lo, hi)
    unknown = req.join(snaps.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown_id"))
    bad = req.join(snaps.select("id"), "id", "left_semi").filter(~F.coalesce(ok_range, F.lit(False))) \
        .withColumn("reason", F.lit("out_of_range"))
    good = req.filter(F.coalesce(ok_range, F.lit(False)))
    upd = snaps.join(good, "id", "left").select(
        *[F.coalesce(F.col("__new"), F.col("actual")).alias("actual") if c == "actual"
          else F.coalesce(F.col("__at"), F.col("recorded_at")).alias("recorded_at") if c == "recorded_at"
          else F.col(c) for c in snaps.columns])
    return upd, unknown.unionByName(bad)


def new_snapshots(preds: DataFrame, label: str = "") -> DataFrame:
    """O-106: snapshot rows with a random unique key (a max+1 counter races under
    concurrent writers) and the creation time; append them with mode('append')."""
    return preds.select(
        F.expr("uuid()").alias("id"), F.lit(label).alias("label"),
        F.col("habits"), F.col("predicted"), F.col("variant"),
        F.lit(None).cast("double").alias("actual"), F.lit(None).cast("timestamp").alias("recorded_at"),
        F.current_timestamp().alias("created_at"),
    )


def most_recent_first(df: DataFrame) -> DataFrame:
    """O-66."""
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc())
