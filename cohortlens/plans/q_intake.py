"""Registered jobs for formulas (O-121 … O-125), intake (O-103, O-116, O-118) and export (O-09)."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import formula as FM
from ..operators import whatif as W
from ..session import scratch_path
from ..sources import batches as BA
from ..sources import intake as IN
from ..sources import upload_folder as UF
from ..sources.tables import read
from .curated import curated
from .oracle import numeric_text_sql, with_curated
from .registry import register, rounded


def _formula_rows(spark, sf_dir, text):
    res = FM.evaluate(curated(spark, sf_dir), text, id_col="subject_id")
    return rounded(res.frame)


@register("formula_row", with_curated(
    "SELECT subject_id AS row_id, ROUND(g1 * 0.3 + g2 * 0.3 + g3 * 0.4, 4) AS resultado FROM curated"))
def q_formula_row(spark, sf_dir):
    return _formula_rows(spark, sf_dir, "G1 * 0.3 + G2 * 0.3 + G3 * 0.4")


@register("formula_agg", with_curated(
    "SELECT ROUND(AVG(g3) - quantile_cont(g3, 0.5) + STDDEV_SAMP(g3) * 2 + COUNT(g1) / COUNT(*), 4) AS resultado "
    "FROM curated"))
def q_formula_agg(spark, sf_dir):
    return rounded(FM.evaluate(curated(spark, sf_dir), "média(g3) - mediana(g3) + desvio(g3) * 2 + contar(g1) / contar()")
                   .frame)


@register("formula_where", with_curated(
    "SELECT subject_id AS row_id, CASE WHEN g3 >= 10 THEN 1 ELSE 0 END AS resultado FROM curated WHERE effort >= 3"))
def q_formula_where(spark, sf_dir):
    return _formula_rows(spark, sf_dir, "se(g3 >= 10, 1, 0) onde effort >= 3")


@register("formula_mixed", with_curated(
    "SELECT subject_id AS row_id, ROUND(g3 - (SELECT AVG(g3) FROM curated WHERE segment = 'BUILDING'), 4) AS resultado "
    "FROM curated WHERE segment = 'BUILDING'"))
def q_formula_mixed(spark, sf_dir):
    return _formula_rows(spark, sf_dir, "g3 - media(g3) where segment = 'BUILDING'")


@register("formula_page", with_curated("""
, r AS (SELECT subject_id AS row_id, (g1 + g2 + g3) / 3 AS resultado FROM curated WHERE failures >= 1)
SELECT COUNT(*) AS total, GREATEST(1, CAST(CEIL(COUNT(*) / 20.0) AS BIGINT)) AS pages,
       ROUND(AVG(resultado), 4) AS mean, ROUND(MIN(resultado), 4) AS min, ROUND(MAX(resultado), 4) AS max FROM r"""))
def q_formula_page(spark, sf_dir):
    res = FM.evaluate(curated(spark, sf_dir), "(G1 + G2 + G3) / 3 onde failures >= 1", id_col="subject_id")
    total, pages, _, _, summary = FM.page(res, 1, 20)
    return rounded(summary.select(F.lit(total).cast("bigint").alias("total"), F.lit(pages).cast("bigint").alias("pages"),
                                  "mean", "min", "max"))


@register("formula_page_rows", with_curated(
    "SELECT subject_id AS row_id, ROUND((g1 + g2 + g3) / 3, 4) AS resultado FROM curated WHERE failures >= 1 "
    "ORDER BY subject_id LIMIT 20 OFFSET 20"))
def q_formula_page_rows(spark, sf_dir):
    """O-125: the rows of the second page."""
    res = FM.evaluate(curated(spark, sf_dir), "(G1 + G2 + G3) / 3 onde failures >= 1", id_col="subject_id")
    return FM.page(res, 2, 20)[3]


@register("formula_quoted", with_curated(
    "SELECT subject_id AS row_id, CASE WHEN segment = 'onde' THEN 1 ELSE 0 END AS resultado FROM curated "
    "WHERE segment <> 'b=c'"))
def q_formula_quoted(spark, sf_dir):
    """Keywords and `=` inside quoted text are text."""
    return _formula_rows(spark, sf_dir, "se(segment == 'onde', 1, 0) where segment != 'b=c'")


CUSTOMER_TEXT = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("infer_types", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, COUNT(NULLIF(trim(CAST({c} AS VARCHAR)), '')) AS n_non_null, "
    f"COUNT({numeric_text_sql(f'NULLIF(trim(CAST({c} AS VARCHAR)), {chr(39)}{chr(39)})')}) AS n_numeric, "
    f"CASE WHEN COUNT(NULLIF(trim(CAST({c} AS VARCHAR)), '')) > 0 AND COUNT(NULLIF(trim(CAST({c} AS VARCHAR)), '')) = "
    f"COUNT({numeric_text_sql(f'NULLIF(trim(CAST({c} AS VARCHAR)), {chr(39)}{chr(39)})')}) THEN 'numeric' ELSE 'text' END "
    f"AS inferred FROM customer" for i, c in enumerate(CUSTOMER_TEXT)))
def q_infer(spark, sf_dir):
    """O-116 on `customer` read as text: which columns are numeric."""
    c = read(spark, sf_dir, "customer").select(*[F.col(x).cast("string").alias(x) for x in CUSTOMER_TEXT])
    return IN.infer_types(c)


BOUNDS = {"nation": (0, 20), "balance": (0, 9999)}
ENUMS = {"segment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")}


def _bulk_input(spark, sf_dir):
    """Intake rows from `customer` as text, with seeded non-numbers in every tenth balance."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("c_custkey") % 10 == 3, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.lower("c_mktsegment").alias("segment"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"),
    )


def _trunc_sql(x):
    return f"CAST(TRUNC({x}) AS BIGINT)"


_BAL = "CASE WHEN c_custkey % 10 = 3 THEN c_name ELSE CAST(c_acctbal AS VARCHAR) END"
_NAT = "CAST(c_nationkey AS VARCHAR)"


def _bulk_sql():
    nat_num, bal_num = numeric_text_sql(f"trim({_NAT})"), numeric_text_sql(f"trim({_BAL})")
    nat_i, bal_i = _trunc_sql(nat_num), _trunc_sql(bal_num)
    seg = "upper(trim(lower(c_mktsegment)))"
    seg_ok = f"{seg} IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')"
    errs = (f"list_filter([CASE WHEN {nat_num} IS NULL THEN 'not_a_number:nation' END, "
            f"CASE WHEN {nat_num} IS NOT NULL AND NOT ({nat_i} BETWEEN 0 AND 20) THEN 'out_of_range:nation' END, "
            f"CASE WHEN {bal_num} IS NULL THEN 'not_a_number:balance' END, "
            f"CASE WHEN {bal_num} IS NOT NULL AND NOT ({bal_i} BETWEEN 0 AND 9999) THEN 'out_of_range:balance' END, "
            f"CASE WHEN NOT ({seg_ok}) THEN 'bad_value:segment' END], lambda e: e IS NOT NULL)")
    return f"""
WITH v AS (SELECT c_custkey, CASE WHEN {nat_i} BETWEEN 0 AND 20 THEN {nat_i} END AS nation,
                  CASE WHEN {bal_i} BETWEEN 0 AND 9999 THEN {bal_i} END AS balance,
                  CASE WHEN {seg_ok} THEN {seg} END AS segment, trim('  ' || c_name || ' ') AS name, {errs} AS errs
           FROM customer)
SELECT c_custkey, nation, balance, segment, name, array_to_string(errs, ',') AS errors, len(errs) = 0 AS valid FROM v"""


@register("bulk_validate", _bulk_sql())
def q_bulk(spark, sf_dir):
    v = IN.validate_rows(_bulk_input(spark, sf_dir), BOUNDS, ENUMS, extras=["name"])
    return v.select("c_custkey", "nation", "balance", "segment", "name", F.array_join("errors", ",").alias("errors"),
                    "valid")


_INTAKE_ORDER = ", ".join(("CAST(c_custkey AS VARCHAR)", _NAT, _BAL, "lower(c_mktsegment)", "c_name"))
_INTAKE_CTE = (f"WITH n AS (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY {_INTAKE_ORDER}) AS row_no FROM customer), "
               f"b AS ({_bulk_sql()}) ")


def _intake(spark, sf_dir):
    """The same upload taken in twice: the second time changes nothing."""
    out = scratch_path(spark, "intake-batches")
    scorer = W.LinearScorer(("nation", "balance"), Decimal("1"), (Decimal("0.25"), Decimal("0.01")), 0.0, 200.0)
    for _ in range(2):
        BA.intake_batch(_bulk_input(spark, sf_dir), BOUNDS, ENUMS, ["name"], {"nation": 0, "balance": 0, "segment": "OTHER"},
                        scorer, "mark", out, batch="customers", label="upload")
    return out


@register("intake_added", _INTAKE_CTE + """SELECT 'customers-' || row_no AS id, c_custkey, nation, balance, segment, name,
       ROUND(1 + 0.25 * nation + 0.01 * balance, 2)::DOUBLE AS mark, 'imputed' AS label_source
FROM b JOIN n USING (c_custkey) WHERE valid""")
def q_intake_added(spark, sf_dir):
    """O-103 end to end: rows added by an upload that was repeated."""
    rows = BA.read_batches(spark, _intake(spark, sf_dir), "added")
    return rows.select("id", "c_custkey", "nation", "balance", "segment", "name", "mark", "label_source")


@register("intake_rejected", _INTAKE_CTE + "SELECT 'customers-' || row_no AS id, c_custkey, errors FROM b JOIN n USING (c_custkey) WHERE NOT valid")
def q_intake_rejected(spark, sf_dir):
    """O-93, O-103: rejects of an upload that was repeated."""
    rows = BA.read_batches(spark, _intake(spark, sf_dir), "rejected")
    return rows.select("id", "c_custkey", F.array_join("errors", ",").alias("errors"))


@register("intake_snapshots", _INTAKE_CTE + """SELECT 'customers-' || row_no AS id, 'upload' AS label,
       ROUND(1 + 0.25 * nation + 0.01 * balance, 2)::DOUBLE AS predicted FROM b JOIN n USING (c_custkey) WHERE valid""")
def q_intake_snapshots(spark, sf_dir):
    """O-106: snapshots of the predictions of an upload that was repeated."""
    return BA.read_batches(spark, _intake(spark, sf_dir), "snapshots").select("id", "label", "predicted")


def _two_dialects(spark, sf_dir):
    """`customer` as uploads: even keys with commas, odd ones with semicolons and other columns."""
    out = scratch_path(spark, "uploads")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("Key"), F.col("c_name").alias("Name"),
                                               F.col("c_acctbal").cast("string").alias("Balance (EUR)"), F.col("c_mktsegment").alias("segment"))
    even = c["Key"].cast("bigint") % 2 == 0
    c.where(even).drop("segment").write.option("header", True).csv(f"{out}/comma")
    c.where(~even).select("segment", "Key", "Name").write.option("header", True).option("sep", ";").csv(f"{out}/semicolon")
    return UF.read_folder(spark, out, file_col=None)


@register("upload_folder", """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS VARCHAR) END AS balance,
       CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer""")
def q_upload_folder(spark, sf_dir):
    """O-07: a folder of files in two dialects as one table."""
    t = _two_dialects(spark, sf_dir)
    return t.select(F.col("Key").alias("key"), F.col("Name").alias("name"), F.col("`Balance (EUR)`").alias("balance"), "segment")


ROLE_NAMES = {"id": ["key", "number"], "amount": ["balance"], "group": ["segment", "class"], "result": ["grade"]}


@register("upload_roles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({cond}) AS n_non_null, '{kind}' AS inferred, {role} AS role, "
    "COUNT(*) >= 5 AS can_import, COUNT(*) >= 30 AS can_train, TRUE AS can_score FROM customer"
    for c, cond, kind, role in (("Key", "TRUE", "numeric", "'id'"), ("Name", "TRUE", "text", "NULL"),
                                ("Balance (EUR)", "c_custkey % 2 = 0", "numeric", "'amount'"), ("segment", "c_custkey % 2 = 1", "text", "'group'"))))
def q_upload_roles(spark, sf_dir):
    """O-116: types, roles and readiness of an uploaded folder."""
    t = UF.upload_overview(_two_dialects(spark, sf_dir), ROLE_NAMES)
    return t.select("column_name", "n_non_null", "inferred", "role", "can_import", "can_train", "can_score")


EXPORT_COLS = ["subject_id", "segment", "age", "effort", "absences", "failures", "g1", "g2", "g3", "perf_band", "at_risk"]


@register("export_view", with_curated(
    "SELECT subject_id, segment, effort AS study_level, absences, failures, g1, g2, g3, perf_band, at_risk "
    "FROM curated WHERE segment = 'MACHINERY' AND perf_band = 'insufficient'"))
def q_export(spark, sf_dir):
    """O-09: fixed column order, a missing column (age) skipped, one renamed header."""
    return IN.export_view(curated(spark, sf_dir), EXPORT_COLS, {"segment": "MACHINERY", "perf_band": "insufficient"},
                          {"effort": "study_level"})


@register("text_folding", "SELECT doc_id, md5(trim(lower(translate(text, '" + IN._ACCENTED + "', '" + IN._PLAIN
          + "')))) AS folded_md5, length(text) AS n_chars FROM documents")
def q_fold(spark, sf_dir):
    """O-118 on whole document texts: accent folding and lower case, JVM-side."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.md5(IN.fold_text(F.col("text"))).alias("folded_md5"),
                    F.length("text").cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------- O-114, O-115
from ..operators import questions as QN  # noqa: E402


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(q, {_sq(w)})" for w in words) + ")"


def _questions_sql() -> str:
    rules = [
        ("q = ''", "fallback"), (_any_sql(QN.HELP_WORDS), "help"),
        (f"sid IS NOT NULL AND {_any_sql(QN.EXPLAIN_WORDS)}", "subject_explain"),
        (f"sid IS NOT NULL AND {_any_sql(QN.PLAN_WORDS)}", "subject_plan"),
        (f"sid IS NOT NULL AND {_any_sql(QN.COMPARE_WORDS)}", "subject_compare"),
        ("sid IS NOT NULL", "subject_status"), (_any_sql(QN.PASS_WORDS), "pass_rate"),
        (_any_sql(QN.RISK_WORDS), "risk"), (_any_sql(QN.MEAN_WORDS), "mean"), (_any_sql(QN.COUNT_WORDS), "count"),
        (_any_sql(QN.CORR_WORDS), "correlation"), (_any_sql(QN.SUMMARY_WORDS), "summary"),
    ] + [(_any_sql(w), f"navigation_{t}") for t, w in QN.NAV_TOPICS]
    case = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + " ELSE 'fallback' END"
    return f"""
WITH b AS (SELECT conv_id, turn, lower(regexp_replace(COALESCE(text, ''), '^\\s+|\\s+$', '', 'g')) AS q
           FROM conversations WHERE role = 'user'),
i AS (SELECT *, regexp_extract(q, {_sq(QN.ID_AFTER_KEYWORD)}, 1) AS first,
             regexp_extract_all(q, '(\\d+)', 1) AS nums FROM b),
s AS (SELECT *, CAST(CASE WHEN first <> '' THEN first
                          WHEN regexp_matches(q, {_sq(QN.SUBJECT_WORD)}) AND len(nums) = 1 THEN nums[1] END AS BIGINT) AS sid
      FROM i),
t AS (SELECT *, list_filter(list_transform(regexp_extract_all(q, {_sq('(' + QN.NUMBER + ')')}, 1),
                                            lambda x: CAST(replace(x, ',', '.') AS DOUBLE)),
                            lambda x: x >= 0 AND x <= 20 AND x <> CAST(sid AS DOUBLE)) AS cands FROM s)
SELECT conv_id, turn, {case} AS intent, sid AS subject_id,
       CASE WHEN sid IS NOT NULL THEN COALESCE(cands[-1], 14.0) END AS target_grade FROM t"""


@register("question_routing", _questions_sql())
def q_questions(spark, sf_dir):
    """O-114/O-115 over every user turn of `conversations` (whole texts)."""
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return QN.route(c, "text", ["conv_id", "turn"])
