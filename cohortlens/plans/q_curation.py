"""Registered curation jobs (O-14 … O-24) on the `subjects` binding."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators.quantiles import column_medians
from ..roles import SUBJECTS as R
from ..sources.tables import read
from .bindings import subjects
from .curated import build_curated, prefiltered
from .oracle import curated_ctes, numeric_text_sql, r6
from .registry import register, rounded

NUM = [c for c in R.numeric_all]
TXT = list(R.categorical)
WIN = ["absences", "g1", "g2", "g3"]
NRM = ["effort", "absences", "failures", "g3"]


def _prefiltered(spark, sf_dir):
    return prefiltered(spark, sf_dir, R)


def _filled(spark, sf_dir):
    pre = _prefiltered(spark, sf_dir)
    med, modes = clean.fit_fill(pre, R)
    return clean.mode_fill(clean.median_fill(pre, med), modes)


@register("dedupe_rows", curated_ctes(upto="s_dedup") + "SELECT * FROM s_dedup")
def q_dedupe(spark, sf_dir):
    return clean.dedupe(subjects(spark, sf_dir), R)


_PADDED = "' ' || CAST(c_custkey AS VARCHAR) || ' '"
_SUFFIXED = "CAST(c_nationkey AS VARCHAR) || 'd'"
_COERCE_SQL = (
    "SELECT c_custkey, "
    f"{numeric_text_sql('c_name')} AS name_num, "
    f"{numeric_text_sql('c_acctbal')} AS acctbal_num, "
    f"{numeric_text_sql(_PADDED)} AS padded_num, "
    f"{numeric_text_sql(_SUFFIXED)} AS suffixed_num "
    "FROM customer"
)


@register("coerce_numeric", _COERCE_SQL)
def q_coerce(spark, sf_dir):
    """O-15 on text columns of `customer`: names, amounts, padded keys and `5d`-like traps."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        clean.numeric_text(F.col("c_name")).alias("name_num"),
        clean.numeric_text(F.col("c_acctbal")).alias("acctbal_num"),
        clean.numeric_text(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("padded_num"),
        clean.numeric_text(F.concat(F.col("c_nationkey").cast("string"), F.lit("d"))).alias("suffixed_num"),
    )


@register("range_filter", curated_ctes(upto="s_kept") + "SELECT * FROM s_kept")
def q_range(spark, sf_dir):
    return clean.prefilter(subjects(spark, sf_dir), R)


@register("median_fill", curated_ctes(upto="s_filled") + f"SELECT subject_id, {', '.join(NUM)} FROM s_filled")
def q_median_fill(spark, sf_dir):
    pre = _prefiltered(spark, sf_dir)
    med, _ = clean.fit_fill(pre, R)
    return clean.median_fill(pre, med).select("subject_id", *NUM)


@register("mode_fill", curated_ctes(upto="s_filled") + f"SELECT subject_id, {', '.join(TXT)} FROM s_filled")
def q_mode_fill(spark, sf_dir):
    pre = _prefiltered(spark, sf_dir)
    _, modes = clean.fit_fill(pre, R)
    return clean.mode_fill(pre, modes).select("subject_id", *TXT)


_WIN_COLS = ", ".join(
    f"{r6(c, c)}, {r6(c + '_raw', c + '_raw')}, {c}_is_outlier" for c in WIN
)


@register("winsorise", curated_ctes(upto="s_capped") + f"SELECT subject_id, {_WIN_COLS} FROM s_capped")
def q_winsorise(spark, sf_dir):
    f = _filled(spark, sf_dir)
    b = clean.fit_bounds(f, R.winsor, R.iqr_factor)
    cols = ["subject_id"] + [x for c in WIN for x in (c, f"{c}_raw", f"{c}_is_outlier")]
    return rounded(clean.winsorise(f, b).select(*cols))


_LI_SPARSE = "SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS discount, NULLIF(l_tax, 0) AS tax FROM lineitem"
_LI_MEDIANS = "SELECT QUANTILE_CONT(CAST(discount AS DOUBLE), 0.5) AS discount, QUANTILE_CONT(CAST(tax AS DOUBLE), 0.5) AS tax FROM s"


@register("median_fill_lineitem", f"WITH s AS ({_LI_SPARSE}), m AS ({_LI_MEDIANS}) SELECT l_orderkey, l_linenumber, "
          + ", ".join(r6(f"COALESCE(CAST(s.{c} AS DOUBLE), m.{c})", c) for c in ("discount", "tax")) + " FROM s, m")
def q_median_fill_lineitem(spark, sf_dir):
    """O-18 on a fact table: a discount or tax of 0 counts as unknown."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[
        F.nullif(F.col(f"l_{c}").cast("double"), F.lit(0.0)).alias(c) for c in ("discount", "tax")])
    return rounded(clean.median_fill(li, column_medians(li, ["discount", "tax"])))


_LI_WIN = ("l_extendedprice", "l_quantity")
_LI_FENCES = ", ".join(f"QUANTILE_CONT(CAST({c} AS DOUBLE), {q}) AS {n}_{c}" for c in _LI_WIN for n, q in (("a", 0.25), ("b", 0.75)))
_LI_CAPPED = ", ".join(
    f"{r6(f'LEAST(GREATEST(CAST({c} AS DOUBLE), a_{c} - 1.5 * (b_{c} - a_{c})), b_{c} + 1.5 * (b_{c} - a_{c}))', c)}, "
    f"{r6(c, c + '_raw')}, CAST({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}) AS INT) AS {c}_is_outlier"
    for c in _LI_WIN)


@register("winsorise_lineitem", f"WITH q AS (SELECT {_LI_FENCES} FROM lineitem) SELECT l_orderkey, l_linenumber, {_LI_CAPPED} FROM lineitem, q")
def q_winsorise_lineitem(spark, sf_dir):
    """O-20 on a fact table of continuous prices."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_LI_WIN)
    capped = clean.winsorise(li, clean.fit_bounds(li, _LI_WIN))
    return rounded(capped.select("l_orderkey", "l_linenumber", *[x for c in _LI_WIN for x in (c, f"{c}_raw", f"{c}_is_outlier")]))


_FEAT = ["passed", "grade_trend", "progress_badge", "at_risk", "perf_band"]


@register("derive_features", curated_ctes(upto="s_feat")
          + "SELECT subject_id, passed, ROUND(grade_trend, 6) AS grade_trend, progress_badge, at_risk, perf_band FROM s_feat")
def q_features(spark, sf_dir):
    f = _filled(spark, sf_dir)
    b = clean.fit_bounds(f, R.winsor, R.iqr_factor)
    return rounded(clean.derive_features(clean.winsorise(f, b), R).select("subject_id", *_FEAT))


@register("zscore", curated_ctes() + "SELECT subject_id, "
          + ", ".join(r6(f"{c}_norm", f"{c}_norm") for c in NRM) + " FROM curated")
def q_zscore(spark, sf_dir):
    df, _ = clean.fit_transform(_prefiltered(spark, sf_dir), R)
    return rounded(df.select("subject_id", *[f"{c}_norm" for c in NRM]))


CURATED_COLUMNS = (
    ["subject_id", "segment", "flag"] + NUM
    + [x for c in WIN for x in (f"{c}_raw", f"{c}_is_outlier")]
    + _FEAT + [f"{c}_norm" for c in NRM]
)
_DOUBLE_COLS = set(NUM) | {f"{c}_raw" for c in WIN} | {"grade_trend"} | {f"{c}_norm" for c in NRM}


@register("curate", curated_ctes() + "SELECT "
          + ", ".join(r6(c, c) if c in _DOUBLE_COLS else c for c in CURATED_COLUMNS) + " FROM curated")
def q_curate(spark, sf_dir):
    """O-24: the whole curation job (always rebuilt, never served from the cache)."""
    df, _ = build_curated(spark, sf_dir, R)
    return rounded(df.select(*CURATED_COLUMNS))
