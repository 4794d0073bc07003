"""Curation (O-14 … O-24): duplicates, coercion, target/range filters, median and
mode filling, IQR winsorising, derived features and z-scores.

Statistics are *fitted* in three steps (medians and modes → IQR bounds →
mean/std; the quantiles by bracket and refine).  Each step returns a few numbers that are turned into
literals, so the final transform is a single scan → filter → project stage
with no join at all.  The pass-through data is materialised once in the
shared checkpoint folder so the passes do not recompute the upstream
aggregation.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.topk import modes
from ..roles import Roles
from .quantiles import column_medians, column_quantiles

# fixed values: number pattern accepted by the coercion (finite decimals only)
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# fixed values: performance bands on the 0..20 scale, right-closed
PERF_BANDS = (
    (-0.1, 9.99, "insufficient"),
    (9.99, 13.99, "sufficient"),
    (13.99, 16.99, "good"),
    (16.99, 20.0, "excellent"),
)


def _is_numeric_type(dt) -> bool:
    return isinstance(dt, T.NumericType)


# ---------------------------------------------------------------- O-14
def dedupe(df: DataFrame, roles: Roles) -> DataFrame:
    """Exact duplicates over the business columns; the lowest key is kept.

    Written as an aggregate (min is combinable), so a duplicate group holding
    a third of the table is reduced map-side before the shuffle instead of
    landing in one window task.
    """
    keys = [c for c in df.columns if c != roles.id]
    return df.groupBy(*keys).agg(F.min(roles.id).alias(roles.id)).select(roles.id, *keys)


# ---------------------------------------------------------------- O-15
def numeric_text(c: Column) -> Column:
    """Text → DOUBLE, anything that is not a finite decimal number → NULL."""
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = {}
    for c in cols:
        if c not in types:
            continue
        out[c] = F.col(c).cast("double") if _is_numeric_type(types[c]) else numeric_text(F.col(c))
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- O-16, O-17
def drop_missing_target(df: DataFrame, roles: Roles) -> DataFrame:
    return df.filter(F.col(roles.target).isNotNull())


def range_filter(df: DataFrame, roles: Roles) -> DataFrame:
    """Every period result must lie in [min, max]; NULL fails the test (as in pandas)."""
    periods = roles.present(roles.periods, df.columns)
    if not periods:
        return df
    cond = reduce(
        lambda a, b: a & b,
        [F.col(p).between(roles.grade_min, roles.grade_max) for p in periods],
    )
    return df.filter(F.coalesce(cond, F.lit(False)))


# ---------------------------------------------------------------- fitted state
@dataclass
class CurationModel:
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)  # col -> (lo, hi)
    moments: dict = field(default_factory=dict)  # col -> (mean, std)


def fit_fill(df: DataFrame, roles: Roles, approx: bool = False) -> tuple[dict, dict]:
    """Pass 1: medians of numeric columns (`quantiles.column_medians`, or one aggregate of sketches)
    and modes of text columns (one distributed group-by, see `functions.topk.modes`)."""
    num = roles.present(roles.numeric_all, df.columns)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    txt = [c for c in df.columns if isinstance(types[c], T.StringType) and c != roles.id]
    if approx and num:
        medians = df.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in num]).first().asDict()
    else:
        medians = column_medians(df, num)
    return medians, modes(df, txt)


def median_fill(df: DataFrame, medians: dict) -> DataFrame:
    out = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double"))
        for c, m in medians.items()
    }
    return df.withColumns(out) if out else df


def mode_fill(df: DataFrame, modes: dict) -> DataFrame:
    out = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items() if m is not None}
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- O-20
def fit_bounds(df: DataFrame, cols, factor: float = 1.5) -> dict:
    """Pass 2: exact Q1/Q3 (linear interpolation) of every column together."""
    out = {}
    for c, q in column_quantiles(df, [c for c in cols if c in df.columns], (0.25, 0.75)).items():
        if q is None:
            continue
        q1, q3 = q
        iqr = q3 - q1
        out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def winsorise(df: DataFrame, bounds: dict) -> DataFrame:
    """Cap to the IQR fences; keeps `<c>_raw` and a 0/1 `<c>_is_outlier` flag."""
    out = {}
    for c, (lo, hi) in bounds.items():
        x = F.col(c).cast("double")
        out[f"{c}_raw"] = x
        out[f"{c}_is_outlier"] = F.coalesce((x < lo) | (x > hi), F.lit(False)).cast("int")
        out[c] = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    # _raw and flag read the uncapped value: withColumns evaluates against the input
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- O-22, O-59
def progress_badge(periods) -> Column:
    steps = [F.col(b) - F.col(a) for a, b in zip(periods, periods[1:])]
    up = reduce(lambda a, b: a & b, [s > 0 for s in steps])
    down = reduce(lambda a, b: a & b, [s < 0 for s in steps])
    return (
        F.when(F.coalesce(up, F.lit(False)), "rising")
        .when(F.coalesce(down, F.lit(False)), "falling")
        .otherwise("stable")
    )


def perf_band(x: Column) -> Column:
    e = None
    for lo, hi, code in PERF_BANDS:
        cond = (x > lo) & (x <= hi)
        e = F.when(cond, code) if e is None else e.when(cond, code)
    return e


def risk_flag(df_cols, roles: Roles) -> Column:
    parts = [F.col(roles.target) < roles.pass_mark]
    if roles.failures and roles.failures in df_cols:
        parts.append(F.col(roles.failures) >= 1)
    if roles.absences and roles.absences in df_cols:
        parts.append(F.col(roles.absences) > roles.absences_risk)
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts]).cast("int")


def derive_features(df: DataFrame, roles: Roles) -> DataFrame:
    cols = set(df.columns)
    y = F.col(roles.target)
    out = {"passed": F.coalesce(y >= roles.pass_mark, F.lit(False)).cast("int")}
    for name, weights in roles.composites:
        if all(c in cols for c, _ in weights):
            total = sum(w for _, w in weights)
            out[name] = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights]) / total
    periods = roles.present(roles.periods, cols)
    if len(periods) >= 2:
        out["grade_trend"] = y - F.col(periods[0])
        out["progress_badge"] = progress_badge(periods)
    out["at_risk"] = risk_flag(cols, roles)
    out["perf_band"] = perf_band(y)
    return df.withColumns(out)


# ---------------------------------------------------------------- O-21
def fit_moments(df: DataFrame, cols) -> dict:
    """Pass 3: mean and sample std (ddof 1) of each column in one aggregate."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"a__{c}"), F.stddev_samp(c).alias(f"s__{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"a__{c}"], row[f"s__{c}"]) for c in cols}


def zscore(df: DataFrame, moments: dict) -> DataFrame:
    out = {}
    for c, (m, s) in moments.items():
        if s is None or s == 0 or m is None:
            out[f"{c}_norm"] = F.lit(0.0)
        else:
            out[f"{c}_norm"] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- O-23
def union_added(base: DataFrame, added: DataFrame, label_source: str | None = "label_source") -> DataFrame:
    """Base rows plus manually added rows, on the columns both share.

    Added rows may carry an imputed (predicted) target; `label_source` marks
    each row `observed` or `imputed` (an added row keeps its own marker if it
    has one), so training can keep observed labels only (SURVEY Q9)."""
    common = [c for c in base.columns if c in set(added.columns) and c != label_source]
    b = base.select(*common)
    a = added.select(*common)
    if label_source:
        b = b.withColumn(label_source, F.lit("observed"))
        src = F.col(label_source) if label_source in added.columns else F.lit("imputed")
        a = added.select(*common, F.coalesce(src, F.lit("imputed")).alias(label_source))
    return b.unionByName(a)


def observed_only(df: DataFrame, label_source: str = "label_source") -> DataFrame:
    """Training rows: observed targets only (rows without the marker are observed)."""
    if label_source not in df.columns:
        return df
    return df.filter(F.col(label_source) == "observed")


# ---------------------------------------------------------------- O-24
def prefilter(df: DataFrame, roles: Roles) -> DataFrame:
    """O-14 … O-17: the steps that need no fitted statistic."""
    df = dedupe(df, roles)
    df = coerce_numeric(df, roles.numeric_all)
    df = drop_missing_target(df, roles)
    return range_filter(df, roles)


def fit_transform(df: DataFrame, roles: Roles, approx: bool = False) -> tuple[DataFrame, CurationModel]:
    """O-18 … O-22 with the three stat passes; `df` should already be materialised."""
    model = CurationModel()
    model.medians, model.modes = fit_fill(df, roles, approx)
    filled = mode_fill(median_fill(df, model.medians), model.modes)
    model.bounds = fit_bounds(filled, roles.winsor, roles.iqr_factor)
    capped = derive_features(winsorise(filled, model.bounds), roles)
    model.moments = fit_moments(capped, roles.norm)
    return zscore(capped, model.moments), model
