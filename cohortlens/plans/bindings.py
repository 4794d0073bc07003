"""Bindings of the driver's tables to the roles the operators expect.

The reference works on one wide table of subjects with three period results.
The driver's tables are a star schema, so a `subjects` table is derived from
customer + orders: one row per customer with order counts and period means
of the order price scaled to 0..20.  The same rule is written once as a
DataFrame job (used by every query) and once as SQL text (used only as the
DuckDB oracle).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read

# fixed values of the binding rule
PERIOD_EDGES = ("1997-01-01 00:00:00", "1999-01-01 00:00:00")
PRICE_SCALE = 25000.0


def _ts(s: str) -> Column:
    return F.to_timestamp_ntz(F.lit(s))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer that has orders.

    orders is aggregated per customer first (partial aggregation runs before
    the shuffle, so a customer holding a third of all orders costs one row per
    map task), then joined to customer on the key the aggregate is already
    partitioned by.
    """
    o = read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"
    )
    t1, t2 = _ts(PERIOD_EDGES[0]), _ts(PERIOD_EDGES[1])
    d, p = F.col("o_orderdate"), F.col("o_totalprice")
    agg = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("n_pending"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("n_urgent"),
        F.avg(F.when(d < t1, p)).alias("p1"),
        F.avg(F.when((d >= t1) & (d < t2), p)).alias("p2"),
        F.avg(F.when(d >= t2, p)).alias("p3"),
    )
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    j = c.join(agg, c.c_custkey == agg.o_custkey, "inner")
    return j.select(
        F.col("c_custkey").alias("subject_id"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") >= 0, "yes").otherwise("no").alias("flag"),
        F.col("n_orders").cast("bigint").alias("n_orders"),
        F.least(F.lit(4), 1 + F.floor(F.col("n_orders") / 5)).cast("int").alias("effort"),
        F.least(F.lit(3), F.greatest(F.lit(0), F.col("n_pending") - 3)).cast("int").alias("failures"),
        (F.col("n_urgent") * 3).cast("int").alias("absences"),
        F.round(F.col("p1") / PRICE_SCALE, 2).alias("g1"),
        F.round(F.col("p2") / PRICE_SCALE, 2).alias("g2"),
        F.round(F.col("p3") / PRICE_SCALE, 2).alias("g3"),
    )


SUBJECTS_SQL = """
SELECT c.c_custkey AS subject_id, c.c_mktsegment AS segment,
       CASE WHEN c.c_acctbal >= 0 THEN 'yes' ELSE 'no' END AS flag,
       CAST(o.n_orders AS BIGINT) AS n_orders,
       CAST(LEAST(4, 1 + FLOOR(o.n_orders / 5)) AS INT) AS effort,
       CAST(LEAST(3, GREATEST(0, o.n_pending - 3)) AS INT) AS failures,
       CAST(o.n_urgent * 3 AS INT) AS absences,
       ROUND(o.p1 / 25000, 2) AS g1, ROUND(o.p2 / 25000, 2) AS g2, ROUND(o.p3 / 25000, 2) AS g3
FROM customer c JOIN (
  SELECT o_custkey, COUNT(*) AS n_orders,
         SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n_pending,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
         AVG(CASE WHEN o_orderdate <  TIMESTAMP '1997-01-01' THEN o_totalprice END) AS p1,
         AVG(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' THEN o_totalprice END) AS p2,
         AVG(CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN o_totalprice END) AS p3
  FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
"""


# Prediction snapshots derived from `events`: each event is a stored prediction
# (predicted = value / 5 on the 0..20 scale); the actual result is the `k` field
# of the JSON properties / 5, recorded at the event time; error events have no
# actual yet (pending).
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    habits = F.from_json("props", "map<string,string>")
    k = F.get_json_object("props", "$.k").cast("double")
    actual = F.when(F.col("event_type") != "error",
                    F.round(F.least(F.greatest(k / 5, F.lit(0.0)), F.lit(20.0)), 2))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("label"),
        habits.alias("habits"),
        F.round(F.least(F.greatest(F.col("value") / 5, F.lit(0.0)), F.lit(20.0)), 2).alias("predicted"),
        actual.alias("actual"),
        F.when(actual.isNotNull(), F.col("ts")).alias("recorded_at"),
        F.col("ts").alias("created_at"),
    )


SNAPSHOTS_SQL = """
SELECT event_id AS id, event_type AS label,
       ROUND(LEAST(GREATEST(value / 5, 0.0), 20.0), 2) AS predicted,
       CASE WHEN event_type <> 'error' THEN
            ROUND(LEAST(GREATEST(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 5, 0.0), 20.0), 2) END AS actual,
       CASE WHEN event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL THEN ts END AS recorded_at,
       ts AS created_at
FROM events
"""
