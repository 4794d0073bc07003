"""Scoring-driven operators (O-36, O-78 … O-84): cohort what-if, greedy plan,
quick wins, local explanation and residual outliers.

A *scorer* turns a frame into a frame with `pred` (clamped to the grade range
and rounded half-even to 2 dp before any comparison, as the reference does).
`LinearScorer` is an exact closed form whose prediction is an ordinary Column
computed in DECIMAL (so rounding ties cannot depend on float noise); any
fitted Spark ML `PipelineModel` can be wrapped with `ModelScorer`.
Candidates (before/after, one row per lever) are exploded into rows and
scored in one pass; nothing is scored row-at-a-time.
"""
from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import Roles
from ..session import scratch_path

DEC = T.DecimalType(18, 6)
MAX_PLAN_STEPS = 80  # fixed value
EXPLAIN_MIN_IMPACT = 0.05  # fixed value
QUICK_WIN_LIMIT = 5  # fixed value
RESIDUAL_Z = 2.0  # fixed value


def _independent(cov: np.ndarray, share: float = 1e-10) -> list[int]:
    """Columns, in order, whose variance isn't explained by those before them."""
    used: list[int] = []
    for j in range(len(cov)):
        rest = cov[j, j]
        if used:
            rest -= cov[j, used] @ np.linalg.solve(cov[np.ix_(used, used)], cov[used, j])
        if rest > share * cov[j, j]:
            used.append(j)
    return used


@dataclass
class LinearScorer:
    inputs: tuple[str, ...]
    intercept: Decimal
    coefs: tuple[Decimal, ...]
    lo: float = 0.0
    hi: float = 20.0

    @classmethod
    def fit(cls, df: DataFrame, inputs, target: str, lo: float = 0.0, hi: float = 20.0) -> "LinearScorer":
        """OLS via the normal equations: one aggregate for means and the sample
        covariance matrix (k×k, k = number of inputs), solved on the driver;
        coefficients are kept at 6 dp.  An input that is constant, or a combination of inputs
        before it, tells nothing new: its coefficient is 0.  No complete row is an error."""
        inputs = tuple(inputs)
        cols = list(inputs) + [target]
        d = df.dropna(subset=cols)
        aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                if j >= i:
                    aggs.append(F.covar_samp(a, b).alias(f"c{i}_{j}"))
        r = d.agg(*aggs).first()
        k = len(inputs)
        if r["m0"] is None:
            raise ValueError("no row has all of " + ", ".join(cols))
        S = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)
        sy = np.array([r[f"c{i}_{k}"] or 0.0 for i in range(k)], dtype=float)
        b, used = np.zeros(k), _independent(S)
        b[used] = np.linalg.solve(S[np.ix_(used, used)], sy[used])
        means = [r[f"m{i}"] for i in range(k + 1)]
        b0 = means[k] - float(np.dot(b, means[:k]))
        q = lambda v: Decimal(str(round(float(v), 6)))
        return cls(inputs, q(b0), tuple(q(v) for v in b), lo, hi)

    def expr(self, values: dict[str, Column] | None = None) -> Column:
        values = values or {}
        acc = F.lit(self.intercept).cast(DEC)
        for c, b in zip(self.inputs, self.coefs):
            x = values.get(c, F.col(c))
            acc = acc + F.lit(b).cast(DEC) * x.cast(DEC)
        clamped = F.least(F.greatest(acc, F.lit(Decimal(str(self.lo)))), F.lit(Decimal(str(self.hi))))
        return F.bround(clamped, 2).cast("double")

    def score(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.expr())


@dataclass
class ModelScorer:
    """Wraps a fitted PipelineModel whose output column is `prediction`."""
    model: object
    inputs: tuple[str, ...]
    lo: float = 0.0
    hi: float = 20.0

    def score(self, df: DataFrame, out: str = "pred") -> DataFrame:
        t = self.model.transform(df)
        p = F.bround(F.least(F.greatest(F.col("prediction"), F.lit(self.lo)), F.lit(self.hi)), 2)
        keep = [c for c in df.columns]
        return t.select(*keep, p.alias(out))


def _levers(roles: Roles, names=None):
    lv = {n: (lo, hi, step, d) for n, lo, hi, step, d in roles.levers}
    if names is None:
        return lv
    bad = [n for n in names if n not in lv]
    if bad:
        raise ValueError(f"unknown lever(s): {', '.join(bad)}; choose from {', '.join(lv)}")
    return {n: lv[n] for n in names}


# ---------------------------------------------------------------- O-36
def fill_defaults(df: DataFrame, defaults_row: dict) -> DataFrame:
    """Sparse request rows get the typical values (a one-row table) for missing fields."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults_row.items() if c in df.columns})


# ---------------------------------------------------------------- O-79, O-53
def what_if_cohort(df: DataFrame, roles: Roles, scorer, deltas: dict[str, float]) -> DataFrame:
    """Same lever deltas for every at-risk row (clamped to lever limits); one
    before/after aggregate.  Empty cohort → a row of zeros."""
    if not deltas:
        raise ValueError("at least one lever delta is required")
    lv = _levers(roles, list(deltas))
    cohort = df.filter(F.col("at_risk") == 1)
    after = {c: F.least(F.greatest(F.col(c) + F.lit(float(d)), F.lit(float(lv[c][0]))), F.lit(float(lv[c][1])))
             for c, d in deltas.items()}
    if isinstance(scorer, LinearScorer):
        scored = cohort.select(scorer.expr().alias("before"), scorer.expr(after).alias("after"))
    else:
        # one frame holding both versions of each row (paired by the table key), scored in one transform
        base = cohort.withColumn("__row", F.col(roles.id))
        both = base.withColumn("__v", F.lit(0)).unionByName(base.withColumns(after).withColumn("__v", F.lit(1)))
        s = scorer.score(both)
        scored = s.groupBy("__row").agg(F.max(F.when(F.col("__v") == 0, F.col("pred"))).alias("before"),
                                        F.max(F.when(F.col("__v") == 1, F.col("pred"))).alias("after"))
    pm = roles.pass_mark
    a = scored.agg(
        F.count(F.lit(1)).alias("n_students"),
        F.count_if(F.col("before") >= pm).alias("n_passing_before"),
        F.count_if(F.col("after") >= pm).alias("n_passing_after"),
        F.count_if((F.col("before") < pm) & (F.col("after") >= pm)).alias("newly_passing"),
        F.avg("before").alias("avg_before"), F.avg("after").alias("avg_after"),
    )
    n = F.col("n_students")
    return a.select(
        "n_students", "n_passing_before", "n_passing_after", "newly_passing",
        F.coalesce(F.try_divide(F.col("n_passing_before"), n), F.lit(0.0)).alias("pass_rate_before"),
        F.coalesce(F.try_divide(F.col("n_passing_after"), n), F.lit(0.0)).alias("pass_rate_after"),
        F.coalesce(F.col("avg_before"), F.lit(0.0)).alias("avg_grade_before"),
        F.coalesce(F.col("avg_after"), F.lit(0.0)).alias("avg_grade_after"),
    )


def _within(col: Column, lever) -> Column:
    lo, hi, step, direction = lever
    move = step * direction
    return (col < hi) if move > 0 else (col > lo)


# ---------------------------------------------------------------- O-81
def quick_wins(df: DataFrame, roles: Roles, scorer: LinearScorer, key: str, limit: int = QUICK_WIN_LIMIT) -> DataFrame:
    """One improving step per lever (within bounds), positive gains only,
    largest first (lever order breaks ties), at most `limit` per row."""
    lv = _levers(roles)
    base = scorer.expr()
    cands = []
    for i, (c, lever) in enumerate(lv.items()):
        new = F.col(c) + F.lit(float(lever[2] * lever[3]))
        gain = (scorer.expr({c: new}).cast(DEC) - base.cast(DEC)).cast("double")
        cands.append(F.when(_within(F.col(c), lever), F.struct(
            F.lit(c).alias("lever"), F.lit(i).alias("lever_no"), F.col(c).cast("double").alias("from_value"),
            new.cast("double").alias("to_value"), gain.alias("gain"))))
    # each row carries its own small candidate array (one entry per lever): sort and
    # cut it in place, no shuffle
    arr = F.array_sort(F.transform(
        F.filter(F.array(*cands), lambda s: s.isNotNull() & (s["gain"] > 0)),
        lambda s: F.struct((-s["gain"]).alias("k"), s["lever_no"].alias("o"), s["lever"].alias("lever"),
                           s["from_value"].alias("from_value"), s["to_value"].alias("to_value"),
                           s["gain"].alias("gain"))))
    return df.select(key, F.posexplode(F.slice(arr, 1, limit)).alias("pos", "s")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("s.lever").alias("lever"), F.col("s.from_value").alias("from_value"),
        F.col("s.to_value").alias("to_value"), F.col("s.gain").alias("gain"))


# ---------------------------------------------------------------- O-83
def explain(df: DataFrame, scorer: LinearScorer, key: str, typical: dict) -> DataFrame:
    """Replace one input at a time by its typical value; impact = base - counterfactual;
    |impact| < 0.05 or an unchanged value is dropped; largest |impact| first."""
    base = scorer.expr()
    items = []
    for i, c in enumerate(scorer.inputs):
        t = F.lit(float(typical[c]))
        impact = (base.cast(DEC) - scorer.expr({c: t}).cast(DEC)).cast("double")
        items.append(F.when((F.col(c).cast("double") != t) & (F.abs(impact) >= EXPLAIN_MIN_IMPACT), F.struct(
            F.abs(impact).alias("abs_impact"), F.lit(-i).alias("o"), F.lit(c).alias("factor"),
            F.col(c).cast("double").alias("value"), t.alias("typical"), impact.alias("impact"))))
    arr = F.reverse(F.array_sort(F.filter(F.array(*items), lambda s: s.isNotNull())))
    return df.select(key, base.alias("base"), F.posexplode(arr).alias("pos", "s")).select(
        key, "base", (F.col("pos") + 1).alias("rank"), "s.factor", "s.value", "s.typical", "s.impact")


# ---------------------------------------------------------------- O-81, O-83 with any scorer
def counterfactuals(df: DataFrame, key: str, candidates: list[dict[str, Column]], scorer, when: list[Column] | None = None) -> DataFrame:
    """(key, base, versions [i, pred]): the prediction of every row as it is and with each candidate's columns.

    A row is exploded into itself and its candidates (those whose `when` holds), all of them go
    through one `score`, and one combinable aggregate folds them back; `key` is unique."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(scorer.inputs)

    def version(i: int, changed: dict[str, Column]) -> Column:
        return F.struct(F.lit(i).alias("i"), *[changed.get(c, F.col(c)).cast(types[c]).alias(c) for c in cols])

    when = when or [F.lit(True)] * len(candidates)
    versions = F.array(version(-1, {}), *[F.when(w, version(i, c)) for i, (c, w) in enumerate(zip(candidates, when, strict=True))])
    rows = df.select(key, F.explode(versions).alias("_v")).where("_v is not null").select(key, F.col("_v.i").alias("_i"), *[F.col(f"_v.{c}").alias(c) for c in cols if c != key])
    scored = scorer.score(rows, "_pred")
    return scored.groupBy(key).agg(
        F.max(F.when(F.col("_i") < 0, F.col("_pred"))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("_i") >= 0, F.struct(F.col("_i").alias("i"), F.col("_pred").alias("pred"))))).alias("versions"))


def _difference(a: Column, b: Column) -> Column:
    """a - b of two predictions of 2 dp."""
    return (a.cast(DEC) - b.cast(DEC)).cast("double")


def quick_wins_scored(df: DataFrame, roles: Roles, scorer, key: str, limit: int = QUICK_WIN_LIMIT) -> DataFrame:
    """`quick_wins` with any scorer, levers that the scorer reads."""
    lv = [(c, lever) for c, lever in _levers(roles).items() if c in scorer.inputs]
    moved = [{c: F.col(c) + F.lit(float(lever[2] * lever[3]))} for c, lever in lv]
    folded = counterfactuals(df, key, moved, scorer, [F.coalesce(_within(F.col(c), lever), F.lit(False)) for c, lever in lv])
    gains = F.transform("versions", lambda s: F.struct((-_difference(s["pred"], F.col("base"))).alias("k"), s["i"].alias("i")))
    best = folded.select(key, F.posexplode(F.slice(F.array_sort(F.filter(gains, lambda s: s["k"] < 0)), 1, limit)).alias("pos", "s"))
    now = F.array(*[F.col(c).cast("double") for c, _ in lv])
    names, moves = F.array(*[F.lit(c) for c, _ in lv]), F.array(*[F.lit(float(lever[2] * lever[3])) for _, lever in lv])
    joined = best.join(df.select(key, now.alias("_now")), key)
    i = F.col("s.i")
    return joined.select(key, (F.col("pos") + 1).alias("rank"), F.get(names, i).alias("lever"), F.get("_now", i).alias("from_value"),
                         (F.get("_now", i) + F.get(moves, i)).alias("to_value"), (-F.col("s.k")).alias("gain"))


def explain_scored(df: DataFrame, scorer, key: str, typical: dict) -> DataFrame:
    """`explain` with any scorer and for text factors too; values come as text.  A NULL value or a NULL
    typical value is not explained."""
    factors = [c for c in scorer.inputs if typical.get(c) is not None]
    types = {f.name: f.dataType for f in df.schema.fields}
    usual = {c: F.lit(typical[c]).cast(types[c]) for c in factors}
    folded = counterfactuals(df, key, [{c: usual[c]} for c in factors], scorer, [F.coalesce(F.col(c) != usual[c], F.lit(False)) for c in factors])
    impacts = F.transform("versions", lambda s: F.struct(F.abs(_difference(F.col("base"), s["pred"])).alias("size"), (-s["i"]).alias("o"), _difference(F.col("base"), s["pred"]).alias("impact")))
    arr = F.reverse(F.array_sort(F.filter(impacts, lambda s: s["size"] >= EXPLAIN_MIN_IMPACT)))
    listed = folded.select(key, "base", F.posexplode(arr).alias("pos", "s"))
    joined = listed.join(df.select(key, F.array(*[F.col(c).cast("string") for c in factors]).alias("_now")), key)
    i = -F.col("s.o")
    return joined.select(key, "base", (F.col("pos") + 1).alias("rank"), F.get(F.array(*[F.lit(c) for c in factors]), i).alias("factor"), F.get("_now", i).alias("value"),
                         F.get(F.array(*[usual[c].cast("string") for c in factors]), i).alias("typical"), F.col("s.impact").alias("impact"))


# ---------------------------------------------------------------- O-84
def residual_outliers(df: DataFrame, scorer, key: str, target: str, z: float = RESIDUAL_Z,
                      limit: int = 20) -> DataFrame:
    """Residual of the model; z with the population std; |z| >= threshold,
    largest first (key breaks ties), at most `limit`; std 0 → empty."""
    s = scorer.score(df.select(key, target, *scorer.inputs)).withColumn("residual", F.col(target) - F.col("pred"))
    st = s.agg(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("sd")).first()
    if not st["sd"]:
        return s.limit(0).select(key, target, "pred", "residual", F.lit(0.0).alias("z"), F.lit("").alias("direction"))
    zc = (F.col("residual") - F.lit(st["m"])) / F.lit(st["sd"])
    return (s.withColumn("z", zc).filter(F.abs("z") >= z).orderBy(F.abs("z").desc(), key).limit(limit)
            .select(key, target, "pred", "residual", "z",
                    F.when(F.col("residual") > 0, "above").otherwise("below").alias("direction")))


# ---------------------------------------------------------------- O-80
def greedy_plan(df: DataFrame, roles: Roles, scorer: LinearScorer, key: str, target_grade: float,
                max_steps: int = MAX_PLAN_STEPS) -> DataFrame:
    """Greedy habit plan for every row, as one row-wise expression (no UDF, no loop).

    Each step tries one unit on every lever within bounds, takes the largest
    strictly positive gain (first lever on ties) and stops at the target,
    when no lever helps, or after `max_steps`.  Gains are on the clamped,
    2-dp predictions.  Output: final lever values, prediction, steps, reached,
    the total change per lever and, as `changes`, the steps in order with those of one lever in a row merged.
    """
    lv = list(_levers(roles).items())
    names = [n for n, _ in lv]

    def pred_of(vals):
        return scorer.expr({n: vals[i] for i, n in enumerate(names)}).cast(DEC)

    start_vals = F.array(*[F.col(n).cast("double") for n in names])
    log_type = "array<struct<k:int,start:double,stop:double>>"
    init = F.struct(start_vals.alias("v"), scorer.expr().cast(DEC).alias("p"), F.lit(0).alias("n"),
                    F.lit(False).alias("stop"), F.array().cast(log_type).alias("log"))
    tgt = F.lit(Decimal(str(target_grade))).cast(DEC)

    moves = F.array(*[F.lit(float(lev[2] * lev[3])) for _, lev in lv])

    def step(acc, _i):
        v, p = acc["v"], acc["p"]
        cands = []
        for k, (n, lever) in enumerate(lv):
            move = float(lever[2] * lever[3])
            nv = [v[j] + F.lit(move) if j == k else v[j] for j in range(len(names))]
            gain = pred_of(nv) - p
            ok = _within(v[k], lever) & (gain > 0)
            cands.append(F.when(ok, F.struct(gain.alias("g"), F.lit(-k).alias("o"), F.lit(k).alias("k"))))
        best = F.array_max(F.filter(F.array(*cands), lambda s: s.isNotNull()))
        stopped = F.struct(v.alias("v"), p.alias("p"), acc["n"].alias("n"), F.lit(True).alias("stop"), acc["log"].alias("log"))

        def take(b):
            newv = F.transform(v, lambda x, j: F.when(j == b["k"], x + F.element_at(moves, j + 1)).otherwise(x))
            log, to = acc["log"], F.get(newv, b["k"])
            last = F.get(log, F.size(log) - 1)
            same = F.coalesce(last["k"] == b["k"], F.lit(False))
            entry = F.struct(b["k"].alias("k"), F.when(same, last["start"]).otherwise(F.get(v, b["k"])).alias("start"), to.alias("stop"))
            kept = F.when(same, F.slice(log, F.lit(1), F.size(log) - 1)).otherwise(log)
            moved = F.struct(newv.alias("v"), (p + b["g"]).cast(DEC).alias("p"), (acc["n"] + 1).alias("n"),
                             F.lit(False).alias("stop"), F.concat(kept, F.array(entry)).cast(log_type).alias("log"))
            return F.when(b.isNull(), stopped).otherwise(moved)

        # the candidates are evaluated only while the row is still moving, and the
        # best one once per step (bound as the lambda variable of a one-element transform)
        return F.when(acc["stop"] | (p >= tgt), stopped).otherwise(F.transform(F.array(best), take)[0])

    plan = F.aggregate(F.sequence(F.lit(1), F.lit(max_steps)), init, step)
    extra = [roles.failures] if roles.failures and roles.failures not in names else []
    out = df.select(key, *names, *extra, plan.alias("plan"))
    cols = [key, F.col("plan.p").cast("double").alias("final_pred"), F.col("plan.n").alias("steps"),
            (F.col("plan.p") >= tgt).alias("reached")]
    for i, n in enumerate(names):
        cols.append(F.col("plan.v")[i].alias(f"{n}_final"))
        cols.append((F.col("plan.v")[i] - F.col(n).cast("double")).alias(f"{n}_change"))
    flag = None
    if roles.failures and roles.effort and roles.effort in names:
        i = names.index(roles.effort)
        flag = ((F.col(roles.failures) >= 1) & (F.col("plan.v")[i] > F.col(roles.effort))).cast("int")
    levers = F.array(*[F.lit(n) for n in names])
    cols.append(F.transform("plan.log", lambda s: F.struct(F.get(levers, s["k"]).alias("lever"), s["start"].alias("from_value"), s["stop"].alias("to_value"))).alias("changes"))
    res = out.select(*cols, *([flag.alias("effort_with_failures_flag")] if flag is not None else []))
    return res


def greedy_plan_scored(df: DataFrame, roles: Roles, scorer, key: str, target_grade: float, max_steps: int = MAX_PLAN_STEPS) -> DataFrame:
    """The plan of `greedy_plan` with any scorer: (key, final_pred, steps, reached, changes).

    Rows that still move are the frontier.  A round scores every lever's next step of every frontier
    row in one `score`, takes the best step of each, and writes the rows to the shared folder; rows that are
    at the target, that nothing helps or that have taken `max_steps` are done and leave the frontier.  There
    are at most `max_steps` rounds, whatever the number of rows.  `key` is unique."""
    lv = [(c, lever) for c, lever in _levers(roles).items() if c in scorer.inputs]
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in scorer.inputs if c != key]
    log_type = "array<struct<lever:string,from_value:double,to_value:double>>"
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "plan")
    start = scorer.score(df.select(key, *cols), "_p").select(key, *cols, "_p", F.lit(0).alias("_n"), F.array().cast(log_type).alias("_log"))
    written = [f"{folder}/0"]
    start.withColumn("_done", F.coalesce(F.col("_p") >= target_grade, F.lit(True)) | F.lit(max_steps < 1)).write.parquet(written[0])
    for step in range(1, max_steps + 1):
        frontier = spark.read.parquet(written[-1]).where("not _done").drop("_done")
        if frontier.isEmpty():
            break
        state = F.struct(*cols, "_p", "_n", "_log")

        def version(i: int, changed: dict[str, Column]) -> Column:
            return F.struct(F.lit(i).alias("i"), F.when(F.lit(i < 0), state).alias("state"), F.col("_p").alias("p"), *[changed.get(c, F.col(c)).cast(types[c]).alias(c) for c in cols])

        tries = [F.when(F.coalesce(_within(F.col(c), lever), F.lit(False)), version(i, {c: F.col(c) + F.lit(float(lever[2] * lever[3]))})) for i, (c, lever) in enumerate(lv)]
        rows = frontier.select(key, F.explode(F.array(version(-1, {}), *tries)).alias("v")).where("v is not null")
        rows = rows.select(key, F.col("v.i").alias("_i"), F.col("v.state").alias("_state"), F.col("v.p").alias("_before"), *[F.col(f"v.{c}").alias(c) for c in cols])
        gain = _difference(F.col("_pred"), F.col("_before"))
        best = F.max(F.when((F.col("_i") >= 0) & (gain > 0), F.struct(gain.alias("gain"), (-F.col("_i")).alias("o"), F.col("_pred").alias("pred"))))
        folded = scorer.score(rows, "_pred").groupBy(key).agg(F.max_by("_state", F.col("_i") < 0).alias("s"), best.alias("b"))
        moved = folded.select(key, *_moved(cols, types, lv, log_type))
        moved.withColumn("_done", F.col("_stuck") | (F.col("_p") >= target_grade) | (F.col("_n") >= max_steps)).drop("_stuck").write.parquet(f"{folder}/{step}")
        written.append(f"{folder}/{step}")
    return spark.read.parquet(*written).where("_done").select(key, F.col("_p").alias("final_pred"), F.col("_n").alias("steps"), (F.col("_p") >= target_grade).alias("reached"), F.col("_log").alias("changes"))


def _moved(cols: list[str], types: dict, lv: list, log_type: str) -> list[Column]:
    """The state after the best step `b` of the state `s`; without one the row is stuck."""
    stuck, k = F.col("b").isNull(), -F.col("b.o")
    out, to = [], F.lit(None).cast("double")
    for c in cols:
        value = F.col(f"s.{c}")
        for i, (name, lever) in enumerate(lv):
            if name == c:
                value = F.when(k == i, (value + F.lit(float(lever[2] * lever[3]))).cast(types[c])).otherwise(value)
                to = F.when(k == i, F.col(f"s.{c}").cast("double") + F.lit(float(lever[2] * lever[3]))).otherwise(to)
        out.append(value.alias(c))
    names, now = F.array(*[F.lit(n) for n, _ in lv]), F.array(*[F.col(f"s.{n}").cast("double") for n, _ in lv])
    log = F.col("s._log")
    last = F.get(log, F.size(log) - 1)
    same = F.coalesce(last["lever"] == F.get(names, k), F.lit(False))
    entry = F.struct(F.get(names, k).alias("lever"), F.when(same, last["from_value"]).otherwise(F.get(now, k)).alias("from_value"), to.alias("to_value"))
    kept = F.when(same, F.slice(log, F.lit(1), F.greatest(F.size(log) - 1, F.lit(0)))).otherwise(log)
    return [*out, F.coalesce("b.pred", "s._p").alias("_p"), (F.col("s._n") + F.when(stuck, 0).otherwise(1)).alias("_n"),
            F.when(stuck, log).otherwise(F.concat(kept, F.array(entry))).cast(log_type).alias("_log"), stuck.alias("_stuck")]
