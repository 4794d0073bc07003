"""SQL text for the DuckDB oracle.

These strings are only the independent check of the Spark jobs: the curated
table is written out as a CTE chain that repeats the curation rules in plain
SQL, so every oracle query can start from `curated`.
"""
from __future__ import annotations

from ..operators.clean import NUMERIC_TEXT, PERF_BANDS
from ..roles import SUBJECTS, Roles
from .bindings import SUBJECTS_SQL

SUBJECT_COLUMNS = ("subject_id", "segment", "flag", "n_orders", "effort", "failures", "absences", "g1", "g2", "g3")


def numeric_text_sql(expr: str) -> str:
    s = f"CAST({expr} AS VARCHAR)"
    return f"CASE WHEN regexp_full_match({s}, '{NUMERIC_TEXT}') THEN TRY_CAST(trim({s}) AS DOUBLE) END"


def perf_band_sql(x: str) -> str:
    whens = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{code}'" for lo, hi, code in PERF_BANDS)
    return f"CASE {whens} END"


def curated_ctes(roles: Roles = SUBJECTS, upto: str = "curated") -> str:
    """`WITH subjects AS (…), …, curated AS (…)`; `upto` names the last CTE needed."""
    cols = [c for c in SUBJECT_COLUMNS if c != roles.id]
    num = [c for c in roles.numeric_all if c in cols]
    txt = [c for c in roles.categorical if c in cols]
    win = [c for c in roles.winsor if c in cols]
    nrm = [c for c in roles.norm if c in cols]
    periods = [c for c in roles.periods if c in cols]
    y, lo_g, hi_g = roles.target, roles.grade_min, roles.grade_max
    ctes = [("subjects", SUBJECTS_SQL)]
    ctes.append(("s_dedup",
        f"SELECT MIN({roles.id}) AS {roles.id}, {', '.join(cols)} FROM subjects GROUP BY {', '.join(cols)}"))
    coerced = [f"CAST({c} AS DOUBLE) AS {c}" if c in num else c for c in cols]
    ctes.append(("s_coerced", f"SELECT {roles.id}, {', '.join(coerced)} FROM s_dedup"))
    rng = " AND ".join(f"{p} BETWEEN {lo_g} AND {hi_g}" for p in periods)
    ctes.append(("s_kept", f"SELECT * FROM s_coerced WHERE {y} IS NOT NULL AND COALESCE({rng}, FALSE)"))
    stats = [f"quantile_cont({c}, 0.5) AS m_{c}" for c in num]
    stats += [
        f"(SELECT {c} FROM s_kept WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS o_{c}"
        for c in txt
    ]
    ctes.append(("s_fill_stats", f"SELECT {', '.join(stats)} FROM s_kept"))
    filled = [f"COALESCE({c}, m_{c}) AS {c}" if c in num else f"COALESCE({c}, o_{c}) AS {c}" for c in cols]
    ctes.append(("s_filled", f"SELECT {roles.id}, {', '.join(filled)} FROM s_kept, s_fill_stats"))
    q = [f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in win]
    ctes.append(("s_quart", f"SELECT {', '.join(q)} FROM s_filled"))
    f = roles.iqr_factor
    fences = [
        f"q1_{c} - {f} * (q3_{c} - q1_{c}) AS lo_{c}, q3_{c} + {f} * (q3_{c} - q1_{c}) AS hi_{c}" for c in win
    ]
    ctes.append(("s_fences", f"SELECT {', '.join(fences)} FROM s_quart"))
    capped = [
        f"{c} AS {c}_raw, CAST(COALESCE({c} < lo_{c} OR {c} > hi_{c}, FALSE) AS INT) AS {c}_is_outlier, "
        f"LEAST(GREATEST({c}, lo_{c}), hi_{c}) AS {c}" for c in win
    ]
    ctes.append(("s_capped",
        f"SELECT s_filled.* EXCLUDE ({', '.join(win)}), {', '.join(capped)} FROM s_filled, s_fences"))
    feats = [f"CAST(COALESCE({y} >= {roles.pass_mark}, FALSE) AS INT) AS passed"]
    if len(periods) >= 2:
        steps = [f"({b} - {a})" for a, b in zip(periods, periods[1:])]
        up = " AND ".join(f"{s} > 0" for s in steps)
        down = " AND ".join(f"{s} < 0" for s in steps)
        feats.append(f"{y} - {periods[0]} AS grade_trend")
        feats.append(
            f"CASE WHEN COALESCE({up}, FALSE) THEN 'rising' WHEN COALESCE({down}, FALSE) THEN 'falling' "
            f"ELSE 'stable' END AS progress_badge"
        )
    risk = [f"COALESCE({y} < {roles.pass_mark}, FALSE)"]
    if roles.failures in cols:
        risk.append(f"COALESCE({roles.failures} >= 1, FALSE)")
    if roles.absences in cols:
        risk.append(f"COALESCE({roles.absences} > {roles.absences_risk}, FALSE)")
    feats.append(f"CAST({' OR '.join(risk)} AS INT) AS at_risk")
    feats.append(f"{perf_band_sql(y)} AS perf_band")
    ctes.append(("s_feat", f"SELECT *, {', '.join(feats)} FROM s_capped"))
    mom = [f"AVG({c}) AS a_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in nrm]
    ctes.append(("s_mom", f"SELECT {', '.join(mom)} FROM s_feat"))
    z = [
        f"CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 0.0 ELSE ({c} - a_{c}) / s_{c} END AS {c}_norm" for c in nrm
    ]
    ctes.append(("curated", f"SELECT s_feat.*, {', '.join(z)} FROM s_feat, s_mom"))
    names = [n for n, _ in ctes]
    ctes = ctes[: names.index(upto) + 1]
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in ctes) + "\n"


def with_curated(body: str, upto: str = "curated") -> str:
    return curated_ctes(upto=upto) + body


def r6(expr: str, alias: str) -> str:
    return f"ROUND({expr}, 6) AS {alias}"
