"""Peer comparisons and per-row insight (O-34, O-35, O-98, O-109, O-111, O-113).

The per-level aggregate (one row per level, its size checked before it is broadcast)
is joined back to every row and to itself shifted by one level, so the insight is produced for all rows in
one job rather than one lookup per row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import bounded
from ..roles import Roles
from .stats import pearson

MIN_GROUP = 5  # fixed value: minimum group size for a next-level comparison


def level_means(df: DataFrame, roles: Roles) -> DataFrame:
    return df.groupBy(roles.effort).agg(F.avg(roles.target).alias("level_mean"), F.count(F.lit(1)).alias("level_n"))


def insight(df: DataFrame, roles: Roles, rows: DataFrame | None = None) -> DataFrame:
    """Every row of `rows` (default: of `df`) against its peer group and the next level in `df`."""
    lv = bounded(level_means(df, roles))
    nxt = lv.select((F.col(roles.effort) - 1).alias("__lvl"), F.col("level_mean").alias("next_mean"),
                    F.col("level_n").alias("next_n"))
    mean_abs = df.agg(F.avg(roles.absences)).first()[0]
    j = (df if rows is None else rows).join(lv, roles.effort, "left").join(nxt, F.col(roles.effort) == F.col("__lvl"), "left")
    y = F.col(roles.target)
    gain = F.col("next_mean") - F.col("level_mean")
    ok = (F.col("level_n") >= MIN_GROUP) & (F.col("next_n") >= MIN_GROUP) & (gain > 0)
    return j.select(
        roles.id, roles.effort, roles.target,
        F.col("level_mean").alias("own_mean"),
        (y - F.col("level_mean")).alias("diff_own"),
        (y >= F.col("level_mean")).cast("int").alias("above_own"),
        F.when(ok, F.col("next_mean")).alias("next_mean"),
        F.when(ok, gain).alias("next_gain"),
        (F.col(roles.failures) >= 1).cast("int").alias("has_failures"),
        (F.col(roles.absences) > F.lit(mean_abs)).cast("int").alias("absences_above_mean"),
    )


def radar(df: DataFrame, features, mask: Column) -> DataFrame:
    """Min-max (whole table) scaled means 0..100 (1 dp), subgroup vs all; span 0 → 50; empty subgroup → 0."""
    m = F.coalesce(mask, F.lit(False))
    aggs = [F.count_if(m).alias("n_sub")]
    for i, c in enumerate(features):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                 F.avg(F.when(m, F.col(c))).alias(f"s{i}"), F.avg(c).alias(f"a{i}")]
    w = df.agg(*aggs)

    def scale(v, i):
        span = F.col(f"hi{i}") - F.col(f"lo{i}")
        return F.when(span == 0, F.lit(50.0)).otherwise(F.bround((v - F.col(f"lo{i}")) / span * 100, 1))

    rows = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ord"),
                     F.when(F.col("n_sub") > 0, scale(F.col(f"s{i}"), i)).otherwise(0.0).alias("subgroup_value"),
                     scale(F.col(f"a{i}"), i).alias("overall_value"), F.col("n_sub").alias("n_subgroup"))
            for i, c in enumerate(features)]
    return w.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def recommendations(df: DataFrame, roles: Roles, no_access: tuple[str, str] | None = None,
                    heavy_use: str | None = None) -> DataFrame:
    """Rule codes per row plus the effort slope of the row's sub-population
    (failures = 0 vs >= 1), i.e. the calibrated gain of one more effort level."""
    mean_abs = df.agg(F.avg(roles.absences)).first()[0]
    sub = F.when(F.col(roles.failures) >= 1, "with_failures").otherwise("no_failures")
    slopes = df.groupBy(sub.alias("subpop")).agg(F.regr_slope(roles.target, roles.effort).alias("effort_slope"))
    rules = [
        F.when(F.col(roles.effort) < 3, F.lit("raise_effort")),
        F.when(F.col(roles.failures) > 0, F.lit("address_failures")),
        F.when(F.col(roles.absences) > F.lit(mean_abs), F.lit("reduce_absences")),
    ]
    if heavy_use and heavy_use in df.columns:
        rules.append(F.when(F.col(heavy_use) > 2, F.lit("reduce_heavy_use")))
    if no_access and no_access[0] in df.columns:
        rules.append(F.when(F.col(no_access[0]) == no_access[1], F.lit("get_access")))
    codes = F.filter(F.array(*rules), lambda x: x.isNotNull())
    j = df.withColumn("subpop", sub).join(F.broadcast(slopes), "subpop", "left")  # two rows by construction
    return j.select(roles.id, "subpop", F.array_join(codes, ",").alias("codes"), F.size(codes).alias("n_codes"),
                    "effort_slope")


def overview(df: DataFrame, roles: Roles, inputs) -> DataFrame:
    """n, pass %, mean target, at-risk %, strongest declared input by |r| and its sign."""
    inputs = [c for c in inputs if c != roles.target and c in df.columns]
    base = df.agg(F.count(F.lit(1)).alias("n"), (F.avg("passed") * 100).alias("pass_pct"),
                  F.avg(roles.target).alias("mean_target"), (F.avg("at_risk") * 100).alias("risk_pct"),
                  *[pearson(c, roles.target).alias(f"r{i}") for i, c in enumerate(inputs)])
    cands = F.filter(F.array(*[F.struct(F.abs(F.col(f"r{i}")).alias("a"), F.lit(-i).alias("o"),
                                        F.lit(c).alias("name"), F.col(f"r{i}").alias("r"))
                                for i, c in enumerate(inputs)]), lambda s: s["r"].isNotNull())
    best = F.array_max(cands)
    return base.select("n", "pass_pct", "mean_target", "risk_pct", best["name"].alias("strongest_factor"),
                       best["r"].alias("strongest_r"),
                       F.when(best["r"] > 0, "positive").when(best["r"] < 0, "negative").alias("strongest_sign"))
