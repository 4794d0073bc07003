"""Question routing over a table of questions (O-114, O-115).

Every question is classified by an ordered chain of substring rules and the
subject id / target grade are pulled out with regular expressions — all as
Column expressions over whole texts, so a table of any size is routed in one
projection.  Answers themselves (prose) are not produced; the intent and the
extracted numbers are what downstream jobs consume.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: keyword lists of each rule, in rule order (Portuguese and English)
HELP_WORDS = ["ajuda", "o que podes fazer", "o que sabes fazer", "ajudar-me", "olá", "ola", "bom dia", "boa tarde",
              "help", "what can you do", "hello", "hi ", "good morning", "good afternoon"]
EXPLAIN_WORDS = ["porque", "por que", "pesa", "explica", "razão", "razao", "why", "explain", "reason"]
PLAN_WORDS = ["chegar a", "atingir", "preciso", "precisa", "meta", "alvo", "reach", "achieve", "need", "needs",
              "target", "goal"]
COMPARE_WORDS = ["compar", "turma", "pares", "média da turma", "media da turma", "compare", "class", "peers",
                 "class average"]
PASS_WORDS = ["taxa de aprovação", "taxa de aprovacao", "aprovados", "quantos passam", "pass rate", "passing rate",
              "how many pass"]
RISK_WORDS = ["risco", "at risk", "at-risk"]
MEAN_WORDS = ["nota média", "nota media", "média das notas", "media das notas", "average grade", "mean grade",
              "average score"]
COUNT_WORDS = ["quantos estudantes", "quantos alunos", "tamanho do dataset", "número de estudantes",
               "numero de estudantes", "how many students", "dataset size", "number of students"]
CORR_WORDS = ["correlacionad", "correlação", "correlacao", "mais afeta", "influencia mais", "correlated",
              "correlation", "most affects", "most influences"]
SUMMARY_WORDS = ["resumo", "panorama", "como está a turma", "como esta a turma", "summary", "overview",
                 "how is the class"]
NAV_TOPICS = [
    ("export", ["exportar", "csv", "download", "descarregar", "export"]),
    ("import", ["importar", "carregar ficheiro", "lote", "import", "upload file", "batch"]),
    ("alerts", ["alertas", "avisos", "notifica", "alerts", "notifications"]),
    ("segmentation", ["segmenta", "perfis", "clusters", "grupos de alunos", "segmentation", "profiles",
                      "student groups"]),
    ("report", ["ficha", "pdf", "relatório individual", "relatorio individual", "report card", "individual report"]),
]
DEFAULT_TARGET = 14.0

# word boundary written out with Unicode classes (same meaning in Java and RE2 engines)
_B = r"(?:^|[^\p{L}\p{N}_])"
_E = r"(?:$|[^\p{L}\p{N}_])"
ID_AFTER_KEYWORD = _B + r"(?:aluno|estudante|id|student)\D{0,5}(\d+)"
SUBJECT_WORD = _B + r"(?:aluno|estudante|student)" + _E
NUMBER = r"\d+(?:[.,]\d+)?"


def _any(q: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [q.contains(w) for w in words])


def subject_id(q: Column) -> Column:
    """Number within 5 non-digits after a keyword; else the only number when a
    subject word is present; else NULL.  A number beyond the range of BIGINT names
    no subject (NULL)."""
    first = F.regexp_extract(q, ID_AFTER_KEYWORD, 1)
    nums = F.regexp_extract_all(q, F.lit(r"(\d+)"), 1)
    lone = F.when(q.rlike(SUBJECT_WORD) & (F.size(nums) == 1), nums[0])
    return F.when(first != "", first).otherwise(lone).try_cast("bigint")


def target_grade(q: Column, sid: Column) -> Column:
    """Last number in 0..20 other than the id (comma or point decimals); default 14."""
    nums = F.transform(F.regexp_extract_all(q, F.lit("(" + NUMBER + ")"), 1),
                       lambda s: F.regexp_replace(s, ",", ".").cast("double"))
    ok = F.filter(nums, lambda x: (x >= 0) & (x <= 20) & (sid.isNull() | (x != sid.cast("double"))))
    return F.coalesce(F.try_element_at(ok, F.lit(-1)), F.lit(DEFAULT_TARGET))


def route(df: DataFrame, text_col: str, keys) -> DataFrame:
    q = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+|\s+$", ""))
    sid = subject_id(q)
    intent = (
        F.when(q == "", "fallback")
        .when(_any(q, HELP_WORDS), "help")
        .when(sid.isNotNull() & _any(q, EXPLAIN_WORDS), "subject_explain")
        .when(sid.isNotNull() & _any(q, PLAN_WORDS), "subject_plan")
        .when(sid.isNotNull() & _any(q, COMPARE_WORDS), "subject_compare")
        .when(sid.isNotNull(), "subject_status")
        .when(_any(q, PASS_WORDS), "pass_rate")
        .when(_any(q, RISK_WORDS), "risk")
        .when(_any(q, MEAN_WORDS), "mean")
        .when(_any(q, COUNT_WORDS), "count")
        .when(_any(q, CORR_WORDS), "correlation")
        .when(_any(q, SUMMARY_WORDS), "summary")
    )
    for topic, words in NAV_TOPICS:
        intent = intent.when(_any(q, words), f"navigation_{topic}")
    intent = intent.otherwise("fallback")
    return df.select(*keys, intent.alias("intent"), sid.alias("subject_id"),
                     F.when(sid.isNotNull(), target_grade(q, sid)).alias("target_grade"))
