"""Segmentation (O-54, O-95 … O-98): K-Means on population-standardised
features, groups ordered by mean target, trait codes, per-group summary.

Spark ML KMeans has no `n_init`: several seeds are fitted and the lowest
training cost is kept.  The z-means per group and the trait codes are one
aggregate plus a small unpivot (groups × features, both parameters).
"""
from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..roles import Roles

# fixed values
MIN_K, MAX_K = 3, 8
RESTARTS = 10
TRAIT_Z = 0.35
MAX_TRAITS = 4
MAX_SUGGESTIONS = 3


def segment(df: DataFrame, roles: Roles, features, k: int = 4, seed: int = 42):
    """Returns (assignments [id, group, z-features…], summary, traits)."""
    feats = list(features)
    unknown = [c for c in feats if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    if len(feats) < 2:
        raise ValueError("at least two features are required")
    k = max(MIN_K, min(MAX_K, int(k)))
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in feats], *[F.stddev_pop(c).alias(f"s_{c}") for c in feats]).first()
    z = {f"z_{c}": F.when(F.lit(st[f"s_{c}"] or 0.0) > 0, (F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"] or 1.0))
         .otherwise(F.lit(0.0)) for c in feats}
    data = df.select(roles.id, roles.target, "at_risk", *feats).withColumns(z)
    vec = VectorAssembler(inputCols=list(z), outputCol="features").transform(data).cache()
    best = None
    for r in range(RESTARTS):
        m = KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="cluster", maxIter=300, tol=1e-4).fit(vec)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    assigned = best[1].transform(vec).drop("features")
    vec.unpersist()
    # order groups by mean target, highest first (cluster number breaks ties)
    order = assigned.groupBy("cluster").agg(F.avg(roles.target).alias("mt"))
    order = order.withColumn("group", F.row_number().over(Window.orderBy(F.col("mt").desc(), "cluster")) - 1)  # k rows
    a = assigned.join(F.broadcast(order.select("cluster", "group")), "cluster").drop("cluster")
    n = df.count()
    summary = a.groupBy("group").agg(
        F.count(F.lit(1)).alias("size"), F.avg(roles.target).alias("mean_target"), F.avg("at_risk").alias("risk_share"),
        *[F.avg(c).alias(f"mean_{c}") for c in feats[:2]], *[F.avg(f"z_{c}").alias(f"zmean_{c}") for c in feats],
    ).withColumn("share", F.col("size") / F.lit(n))
    traits = trait_codes(summary, feats)
    return a, summary.join(traits, "group", "left"), traits


def trait_codes(summary: DataFrame, feats) -> DataFrame:
    """O-96/O-97: features with |mean z| >= 0.35, at most 4 by |deviation|;
    code `<feature>_high|low`; name = first two codes or `mixed`; at most 3
    suggestion codes."""
    long = summary.select("group", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("o"), F.col(f"zmean_{c}").alias("z")) for i, c in enumerate(feats)
    ])).alias("t")).select("group", "t.*").filter(F.abs("z") >= TRAIT_Z)
    w = Window.partitionBy("group").orderBy(F.abs("z").desc(), "o")  # ≤ features per group
    top = long.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= MAX_TRAITS)
    code = F.concat(F.col("feature"), F.when(F.col("z") > 0, F.lit("_high")).otherwise(F.lit("_low")))
    g = top.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("r", code.alias("c")))).alias("a"))
    codes = F.transform("a", lambda s: s["c"])
    return g.select("group", codes.alias("trait_codes"),
                    F.when(F.size(codes) > 0, F.array_join(F.slice(codes, 1, 2), "+")).otherwise("mixed").alias("name"),
                    F.slice(codes, 1, MAX_SUGGESTIONS).alias("suggestion_codes"))
