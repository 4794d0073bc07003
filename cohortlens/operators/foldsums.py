"""Cross-validation of linear fits from fold sums (O-87) and metrics of scored rows (O-89, O-92).

A linear least-squares fit needs only counts, means and covariances, and those of a training part are those of the folds in
it added up.  One aggregate per (fold, levels of the text inputs) gives the moments of the numeric inputs and the
target; text levels are constant within such a group, so the moments of their indicators follow from the counts.
Every fold's fit, its R² on the rows left out, the final fit and its test metrics come from that one small table.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import prefix_sums

MOST_GROUPS = 20_000


@dataclass
class Moments:
    """Count, mean and sum of products about the mean of the columns (design..., target)."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def added(parts: list["Moments"]) -> "Moments":
        n = sum(p.n for p in parts)
        if not n:
            return Moments(0.0, parts[0].mean * 0, parts[0].products * 0)
        mean = sum(p.n * p.mean for p in parts) / n
        return Moments(n, mean, sum(p.products + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts))

    def fit(self) -> tuple[float, np.ndarray]:
        """(intercept, coefficients): least squares, the shortest of equal solutions on standardised columns."""
        x, r = self.products[:-1, :-1], self.products[:-1, -1]
        scale = np.sqrt(np.diag(x))
        scale[scale <= 1e-9 * np.sqrt(max(self.n, 1))] = np.inf  # a constant column tells nothing
        b = np.linalg.lstsq(x / np.outer(scale, scale), r / scale, rcond=1e-10)[0] / scale
        return float(self.mean[-1] - b @ self.mean[:-1]), b

    def squared_error(self, intercept: float, b: np.ndarray) -> float:
        """Sum of squared residuals of a fit on these rows."""
        v = np.append(-b, 1.0)
        return float(v @ self.products @ v + self.n * (v @ self.mean - intercept) ** 2)

    def r2(self, intercept: float, b: np.ndarray) -> float | None:
        total = self.products[-1, -1]
        return float(1.0 - self.squared_error(intercept, b) / total) if total > 0 else None


@dataclass
class LinearFit:
    """A fitted line and the R² of each fold; `expr` predicts (an unseen level has no term of its own)."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]
    intercept: float
    coefs: tuple[float, ...]
    fold_r2: tuple[float | None, ...]
    test_r2: float | None
    test_rmse: float | None

    @property
    def cv_r2(self) -> tuple[float | None, float | None]:
        """Mean and (population) deviation over the folds that have an R²."""
        known = [r for r in self.fold_r2 if r is not None]
        return (float(np.mean(known)), float(np.std(known))) if known else (None, None)

    def expr(self) -> Column:
        out, at = F.lit(self.intercept), len(self.numeric)
        for c, b in zip(self.numeric, self.coefs):
            out = out + F.col(c).cast("double") * F.lit(b)
        for c, known in zip(self.categorical, self.levels):
            if known:
                terms = F.create_map(*[x for lv, b in zip(known, self.coefs[at:]) for x in (F.lit(lv), F.lit(b))])
                out = out + F.coalesce(F.try_element_at(terms, F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(0.0))
            at += len(known)
        return out


def linear_folds(df: DataFrame, label: str, numeric, categorical, fold: Column, folds: int, test: Column) -> LinearFit:
    """Fit on the rows that aren't `test`, with the R² of each of their folds (0 .. folds - 1) fitted on the others.

    Rows with a NULL number or target take no part; a NULL text counts as the empty one.  More than
    MOST_GROUPS combinations of levels and folds are an error: code such inputs as numbers first."""
    numeric, categorical = tuple(numeric), tuple(categorical)
    cols = [*numeric, label]
    rows = df.dropna(subset=cols).select(
        F.when(test, F.lit(-1)).otherwise(fold).cast("int").alias("_fold"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(categorical)])
    m = len(cols)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    groups = rows.groupBy("_fold", *[f"c{i}" for i in range(len(categorical))]).agg(
        F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(m)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}_{j}") for i, j in pairs])
    found = groups.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} combinations of the levels of {', '.join(categorical)}")
    levels = tuple(tuple(sorted({r[f"c{i}"] for r in found})) for i in range(len(categorical)))
    width = m - 1 + sum(map(len, levels))

    parts: dict[int, list[Moments]] = {}
    for r in found:
        mean, products = np.zeros(width + 1), np.zeros((width + 1, width + 1))
        place = [*range(m - 1), width]
        mean[place] = [r[f"m{i}"] for i in range(m)]
        for i, j in pairs:
            products[place[i], place[j]] = products[place[j], place[i]] = r["n"] * r[f"s{i}_{j}"]
        at = m - 1
        for i, known in enumerate(levels):
            mean[at + known.index(r[f"c{i}"])] = 1.0
            at += len(known)
        parts.setdefault(r["_fold"], []).append(Moments(float(r["n"]), mean, products))
    none = Moments(0.0, np.zeros(width + 1), np.zeros((width + 1, width + 1)))
    sums = {f: Moments.added(parts.get(f, [none])) for f in range(-1, folds)}
    fold_r2 = tuple(sums[f].r2(*Moments.added([sums[g] for g in range(folds) if g != f]).fit()) if sums[f].n else None for f in range(folds))
    intercept, b = Moments.added([sums[f] for f in range(folds)]).fit()
    held = sums[-1]
    rmse = float(np.sqrt(max(held.squared_error(intercept, b), 0.0) / held.n)) if held.n else None
    return LinearFit(numeric, categorical, levels, intercept, tuple(map(float, b)), fold_r2, held.r2(intercept, b) if held.n else None, rmse)


def hash_bucket(key: str, buckets: int, salt: str = "") -> Column:
    """A bucket from the first 8 hexadecimal digits of the key's MD5: the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------- O-89
def binary_scores(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """One row: accuracy, precision, recall and F1 of the positive class (0 where undefined) and the ROC-AUC."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    rows = df.where(y.isNotNull() & p.isNotNull())
    one = rows.agg(F.count("*").alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if(y == p).alias("ok"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    area = one_vs_rest_auc(rows.select(y.alias("y"), F.array(F.col(score).cast("double")).alias("p")), "y", "p", [1]).first()
    return one.select("n", share(F.col("ok"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
                      share(2 * precision * recall, precision + recall).alias("f1"), F.lit(area["auc"] if area else None).cast("double").alias("roc_auc"))


# ---------------------------------------------------------------- O-92
def one_vs_rest_auc(df: DataFrame, label: str, scores: str, classes: list[int]) -> DataFrame:
    """(class, n, auc) of every class: `scores` is an array with one score for each of `classes`, `label` the class of the row.

    Each row is exploded once into its scores; rows are counted for each (class, score), and the areas
    follow from the rank sum: a positive row wins against every other one below it and half of those at
    its score, counted by prefix sums over the distinct scores.  NULL where a class or its rest has no row.
    A row with a NULL label or score takes no part in that curve."""
    entries = F.array(*[F.struct(F.lit(c).alias("class"), F.get(scores, F.lit(i)).alias("score"), (F.col(label) == c).cast("long").alias("hit")) for i, c in enumerate(classes)])
    rows = df.where(F.col(label).isNotNull()).select(F.explode(entries).alias("e")).select("e.*").where(F.col("score").isNotNull())
    counts = rows.groupBy("class", "score").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("rest"))
    below = prefix_sums(counts, ["class", "score"], {"rest_below": F.col("rest")}, inclusive=False, groups=["class"])
    areas = below.groupBy("class").agg(F.sum("hits").alias("n"), F.sum("rest").alias("others"), F.sum(F.col("hits") * (F.col("rest_below") + F.col("rest") / 2)).alias("wins"))
    areas = areas.select("class", "n", F.try_divide(F.col("wins"), F.col("n").cast("double") * F.col("others")).alias("auc"))
    every = df.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    return every.join(areas, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), "auc")
