"""Alerts and checks (O-99, O-100, O-102, O-65).

Rules are evaluated from one statistics pass (mean/std/median as literals)
and one pass of conditional counts; the fired rules are a small table sorted
by severity then rule order.  The unusual-value check runs on whole batches of
rows and emits one row per finding.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import Roles
from .quantiles import column_medians
from .ranks import value_counts_before_multi

# fixed values: severity order and rule order
SEVERITY_RANK = {"urgent": 0, "warning": 1, "info": 2}
RISK_RATE_THRESHOLD = 0.30
COMBINED_URGENT_SHARE = 0.05
HEAVY_USE_LEVEL = 3.0
UNUSUAL_Z = 2.5
GRADE_JUMP = 8.0
MANY_FAILURES = 3
HIGH_GRADE = 15.0


def _severity_rank(c: Column) -> Column:
    return F.when(c == "urgent", 0).when(c == "warning", 1).otherwise(2)


def combined_risk(df: DataFrame, roles: Roles, median_absences: float | None = None) -> DataFrame:
    """O-100: absences above the median AND failures >= 1; group vs rest mean
    target and gap; urgent when the group is >= 5 % of rows; no row when empty."""
    a, f, y = F.col(roles.absences), F.col(roles.failures), F.col(roles.target)
    if median_absences is None:
        median_absences = column_medians(df, [roles.absences])[roles.absences]
    m = F.coalesce((a > F.lit(median_absences)) & (f >= 1), F.lit(False))
    r = df.agg(
        F.count_if(m).alias("n_combined"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(m, y)).alias("mean_combined"), F.avg(F.when(~m, y)).alias("mean_rest"),
    )
    share = F.try_divide(F.col("n_combined"), F.col("n"))
    return r.filter(F.col("n_combined") > 0).select(
        F.lit(median_absences).cast("double").alias("median_absences"), "n_combined", "n",
        share.alias("share"), "mean_combined", "mean_rest",
        (F.col("mean_rest") - F.col("mean_combined")).alias("gap"),
        F.when(share >= COMBINED_URGENT_SHARE, "urgent").otherwise("warning").alias("severity"),
    )


def alert_rules(df: DataFrame, roles: Roles, risk_rate_threshold: float | None = None,
                min_absences: float | None = None, heavy_use: str | None = None) -> DataFrame:
    """O-99: fired rules (rule_id, severity, n, value), sorted urgent → info.

    `risk_rate_threshold` in 0.01..0.99 (None → 0.30); `min_absences` None → mean + 2·std.
    `heavy_use` names a composite consumption column for the last rule (skipped if absent).
    """
    thr = RISK_RATE_THRESHOLD if risk_rate_threshold is None else float(risk_rate_threshold)
    if not 0.01 <= thr <= 0.99:
        raise ValueError("risk_rate_threshold must be within 0.01..0.99")
    a, f, y = F.col(roles.absences), F.col(roles.failures), F.col(roles.target)
    st = df.agg(F.avg(a).alias("m"), F.stddev_samp(a).alias("s")).first()
    median_absences = column_medians(df, [roles.absences])[roles.absences]
    high = float(min_absences) if min_absences is not None else (
        (st["m"] or 0.0) + 2 * (st["s"] if st["s"] is not None else float("nan")))
    worsening = F.coalesce((f >= 1) & (F.col("grade_trend") < 0), F.lit(False))
    comb = F.coalesce((a > F.lit(median_absences)) & (f >= 1), F.lit(False))
    aggs = [
        F.avg("at_risk").alias("risk_rate"),
        F.count_if(F.coalesce(a > F.lit(high), F.lit(False))).alias("n_high_absences"),
        F.count_if(worsening).alias("n_worsening"),
        F.count_if(comb).alias("n_combined"),
        F.count(F.lit(1)).alias("n"),
    ]
    has_heavy = heavy_use is not None and heavy_use in df.columns
    if has_heavy:
        aggs.append(F.count_if(F.coalesce((F.col(heavy_use) >= HEAVY_USE_LEVEL) & (y < roles.pass_mark),
                                          F.lit(False))).alias("n_heavy"))
    c = df.agg(*aggs)

    def rule(no, rid, sev, n, value, fired):
        return F.struct(F.lit(no).alias("rule_no"), F.lit(rid).alias("rule_id"), sev.alias("severity"),
                        n.cast("bigint").alias("n"), value.cast("double").alias("value"), fired.alias("fired"))

    comb_sev = F.when(F.try_divide(F.col("n_combined"), F.col("n")) >= COMBINED_URGENT_SHARE, "urgent") \
        .otherwise("warning")
    rules = [
        rule(1, "risk_rate_high", F.lit("urgent"), F.round(F.col("risk_rate") * F.col("n")), F.col("risk_rate"),
             F.coalesce(F.col("risk_rate") >= thr, F.lit(False))),
        rule(2, "high_absences", F.lit("warning"), F.col("n_high_absences"), F.lit(high),
             F.col("n_high_absences") > 0),
        rule(3, "worsening_with_failures", F.lit("warning"), F.col("n_worsening"), F.lit(None),
             F.col("n_worsening") > 0),
        rule(4, "combined_risk", comb_sev, F.col("n_combined"), F.lit(median_absences), F.col("n_combined") > 0),
    ]
    if has_heavy:
        rules.append(rule(5, "heavy_use_low_target", F.lit("info"), F.col("n_heavy"), F.lit(HEAVY_USE_LEVEL),
                          F.col("n_heavy") > 0))
    exploded = c.select(F.explode(F.array(*rules)).alias("r")).select("r.*")
    fired = exploded.filter("fired").drop("fired")
    # the all-clear row appears only when nothing fired
    any_fired = exploded.agg(F.max(F.col("fired").cast("int")).alias("k"))
    clear = any_fired.filter(F.col("k") == 0).select(
        F.lit(99).alias("rule_no"), F.lit("all_clear").alias("rule_id"), F.lit("info").alias("severity"),
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("value"))
    out = fired.unionByName(clear)
    return out.withColumn("severity_rank", _severity_rank(F.col("severity"))).orderBy("severity_rank", "rule_no")


def unusual_values(df: DataFrame, roles: Roles, fields, key: str, reference: DataFrame | None = None) -> DataFrame:
    """O-102 on whole batches: one row per finding (key, field, severity, code, z, percentile).

    z uses the reference table's mean and sample std (fields with zero/NULL std
    are skipped); percentile = share of reference rows <= the value, ×100.
    """
    ref = reference if reference is not None else df
    fields = [c for c in fields if c in df.columns and c in ref.columns]
    st = ref.agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(c).alias(f"m_{c}") for c in fields],
                 *[F.stddev_samp(c).alias(f"s_{c}") for c in fields]).first()
    n = st["n"]
    findings = []
    usable = []
    for c in fields:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        if not s or s != s:
            continue
        usable.append(c)
        z = (F.col(c) - F.lit(m)) / F.lit(s)
        findings.append(F.when(F.abs(z) >= UNUSUAL_Z, F.struct(
            F.lit(c).alias("field"), F.lit("warning").alias("severity"),
            F.when(z > 0, "much_higher").otherwise("much_lower").alias("code"),
            z.alias("z"), F.col(c).cast("double").alias("value"))))
    p = [x for x in roles.periods if x in df.columns]
    if len(p) >= 2:
        d = F.col(p[1]) - F.col(p[0])
        findings.append(F.when(F.abs(d) >= GRADE_JUMP, F.struct(
            F.lit(p[1]).alias("field"), F.lit("warning").alias("severity"),
            F.when(d > 0, "jump_up").otherwise("jump_down").alias("code"),
            d.alias("z"), F.lit(None).cast("double").alias("value"))))
    if roles.failures in df.columns and len(p) >= 2:
        hi = (F.col(p[0]) >= HIGH_GRADE) | (F.col(p[1]) >= HIGH_GRADE)
        findings.append(F.when((F.col(roles.failures) >= MANY_FAILURES) & F.coalesce(hi, F.lit(False)), F.struct(
            F.lit(roles.failures).alias("field"), F.lit("info").alias("severity"),
            F.lit("many_failures_high_grades").alias("code"), F.lit(None).cast("double").alias("z"),
            F.lit(None).cast("double").alias("value"))))
    arr = F.filter(F.array(*findings), lambda e: e.isNotNull())
    found = df.select(key, F.explode(arr).alias("f")).select(key, "f.*")
    if not usable:
        return found.withColumn("percentile", F.lit(None).cast("double")).drop("value")
    # share of reference rows <= value, from one distinct-value prefix table for all fields,
    # joined only to the findings (z findings carry their value; the others do not match)
    ecdf = value_counts_before_multi(ref, usable).select(
        "field", F.col("value").alias("__v"), ((F.col("before") + F.col("cnt")) / F.lit(n) * 100).alias("percentile"))
    j = found.join(ecdf, (found["field"] == ecdf["field"]) & (found["value"] == ecdf["__v"]), "left")
    return j.select(key, found["field"], "severity", "code", "z", "percentile")
