"""Regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over `text_stats` (standardised); its covariance is shrunk
towards the pooled one and towards a multiple of the identity.  A score is the logistic
of a calibrated difference of the two log-densities, computed from cached inverse
Cholesky factors.

Fitting gathers sums only: per class the count, the sum vector and the sum of outer
products, pre-summed in every task and added by Spark, so the driver receives
2 * (1 + d + d * d) numbers whatever the size of the corpus.  The calibration reads
counts over a fixed number of bins of the log-density difference.  All labelled rows
outside the held-out fold are used; there is no sample.

Defined results: a null or empty text is scored as the empty text; a null id is never
learned from and has held_out null; repeated rows are scored one by one, and of
repeated labels the largest counts; with no labelled row of one of the classes every
score is the share of label 1 among the rows learned from (0.5 with none).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, text_or_empty
from .text_stats import NAMES, text_stats


def stats_column(text: Column) -> Column:
    """`text_stats` of whole texts as array<double>."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([text_stats(t) for t in texts])

    return stats(text)


@dataclass(frozen=True)
class Qda:
    """mean/scale standardise; per class 0, 1: centre, inverse Cholesky factor and log constant."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    centres: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    constants: tuple[float, ...] = ()
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Compressed difference of log-densities, class 1 less class 0."""
        z = (x - self.mean) / self.scale
        dens = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.centres, self.factors, self.constants, strict=True)]
        return np.arcsinh(dens[1] - dens[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -50, 50)))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), len(NAMES))


def _sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per class 1, the statistics and their products, summed over all rows."""
    d = len(NAMES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.hstack([np.ones((len(batch), 1)), _matrix(batch["stats"])])
            for k in (0, 1):
                part = x[(batch["y"] == k).to_numpy()]
                total[k] = total.get(k, 0) + part.T @ part
        for k, m in total.items():
            yield pd.DataFrame({"y": k, "pos": np.arange(m.size), "value": m.ravel()})

    summed = rows.mapInPandas(partial, "y int, pos int, value double").groupBy("y", "pos").agg(F.sum("value").alias("value")).toPandas()
    return {
        int(k): g.sort_values("pos")["value"].to_numpy().reshape(d + 1, d + 1)
        for k, g in summed.groupby("y")
        if g.loc[g["pos"] == 0, "value"].iloc[0] > 0
    }


def fit(rows: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.02, bins: int = 400) -> Qda:
    """Fit on rows (y int 0/1, stats array<double>); the two shares are the shrinkage weights."""
    sums = _sums(rows)
    n = {k: s[0, 0] for k, s in sums.items()}
    if len(n) < 2:
        return Qda(prior=float(max(n, default=0.5)) if n else 0.5)
    total = sums[0] + sums[1]
    mean = total[0, 1:] / total[0, 0]
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - mean**2, 1e-8))
    centres, covs = [], []
    for k in (0, 1):
        m = sums[k][0, 1:] / n[k]
        cov = sums[k][1:, 1:] / n[k] - np.outer(m, m)
        centres.append((m - mean) / scale)
        covs.append(cov / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    factors, constants = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * covs[k] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(float(-np.log(np.diag(low)).sum() + np.log(n[k])))
    model = Qda(float(n[1] / (n[0] + n[1])), mean, scale, tuple(centres), tuple(factors), tuple(constants))

    @F.pandas_udf("double")
    def margin(stats: pd.Series) -> pd.Series:
        return pd.Series(model.margin(_matrix(stats)))

    width = 16.0 / bins  # arcsinh of a difference of 4 million is 16
    binned = rows.select("y", F.floor(F.least(F.greatest(margin("stats"), F.lit(-16.0)), F.lit(16.0)) / width).alias("bin")).groupBy("y", "bin").count().toPandas()
    slope, offset = _platt((binned["bin"].to_numpy() + 0.5) * width, binned["y"].to_numpy(), binned["count"].to_numpy())
    return Qda(model.prior, mean, scale, model.centres, model.factors, model.constants, slope, offset)


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic regression on one input by Newton steps with a small ridge."""
    x = np.column_stack([z, np.ones(len(z))])
    b = np.array([0.5, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        grad = x.T @ (w * (p - y)) + 1e-3 * b
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def score_column(model: Qda, stats: Column) -> Column:
    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(rows)))

    return score(stats)


def labelled(stats: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """Rows to learn from: `y` joined by id, without the held-out fold."""
    y = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
        .where(crc_fold("_id", folds) != held_out)
    )
    return stats.join(y, stats[id_col] == y["_id"]).drop("_id")


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, stats_column(text_or_empty(text_col)).alias("stats"))
