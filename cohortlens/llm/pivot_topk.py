"""Exact top-k inner products by elimination with a pivot table.

Vectors are first turned into integers, floor(1024 x).  Each has its distances to the pivots
precomputed.  For a query, the largest |d(q, p) - d(x, p)| over all pivots is a lower bound of
d(q, x), so (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product.  Candidates are
evaluated in the order of that bound, and a query stops as soon as the next bound is below its
k-th best score: what is left cannot enter its result.

A row belongs to the cell of its nearest pivot.  For a cell, the smallest and largest
distance to every pivot and the largest norm give one bound for all its rows, so whole cells are
eliminated before any row of them is sent to a query.  A query's first k-th best score comes
from the sample that the pivots are chosen from.

Bounded by parameters, whatever the corpus: the sample (`sample` rows by hash of the id), the
pivots and the table of cells.  Everything else is dealt into blocks (vector_blocks.py).

Defined results: vectors that are null or empty or hold a null or non-finite component take no
part, nor do rows with a null id; vectors of different lengths are not compared; rows of one id
are one candidate (its best score), and a query never meets a row of its own id; ties go to the
smaller vec_id; fewer candidates than k give them all; scores beyond the range of long are
clipped to it; other columns of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import search, usable

LONG = 2**63 - 1


def quantise(vector, scale: int = 1024) -> np.ndarray:
    return np.floor(np.asarray(vector, dtype=np.float64) * scale)


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum fits, else in Python's integers."""
    if not len(rows) or np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * len(query) < 2**53:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    sums = [sum(int(x) * y for x, y in zip(row, q, strict=True)) for row in rows]
    return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], dtype=np.int64)


def choose_pivots(sample: list[np.ndarray], pivots: int) -> list[np.ndarray]:
    """Far apart from each other: the next pivot is the sample vector farthest from those chosen."""
    if not sample:
        return []
    dim = max(map(len, sample))
    x = np.array([fitted(v, dim) for v in sample])
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return [x[k] for k in chosen]


def fitted(v: np.ndarray, dim: int) -> np.ndarray:
    """Cut or filled up with zeros to another length (a pivot may be any point of a vector's space)."""
    return v[:dim] if len(v) >= dim else np.concatenate([v, np.zeros(dim - len(v))])


def top_k(vectors: DataFrame, query_ids, k: int = 10, pivots: int = 48, sample: int = 1024, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest inner products; `query_ids(column)` picks the queries."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable("v") & F.col("vec_id").isNotNull())
    drawn = [(r["vec_id"], quantise(r["v"], scale)) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    centres = choose_pivots([v for _, v in drawn], pivots)
    n_cells = max(len(centres), 1)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ints = [quantise(v, scale) for v in batch["v"]]
            by_dim = {d: np.array([fitted(c, d) for c in centres]) for d in set(map(len, ints))}
            dist = [np.sqrt(((by_dim[len(v)] - v) ** 2).sum(axis=1)) for v in ints]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": pd.Series(ints, dtype=object), "d": pd.Series(dist, dtype=object), "cell": [int(d.argmin()) for d in dist]})

    table = rows.mapInPandas(describe, "vec_id long, v array<double>, d array<double>, cell int")

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, d, v in zip(batch["cell"], batch["d"], batch["v"], strict=True):
                x = np.append(d, (np.asarray(v) ** 2).sum())
                low[cell] = np.minimum(low[cell], x) if cell in low else x
                high[cell] = np.maximum(high[cell], x) if cell in high else x
        for cell in low:
            yield pd.DataFrame({"cell": cell, "pos": np.arange(n_cells + 1), "low": low[cell], "high": high[cell]})

    ranges = table.mapInPandas(summarise, "cell int, pos int, low double, high double").groupBy("cell", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    low, high = np.full((n_cells, n_cells + 1), np.inf), np.full((n_cells, n_cells + 1), -np.inf)
    low[ranges["cell"], ranges["pos"]] = ranges["low"]
    high[ranges["cell"], ranges["pos"]] = ranges["high"]
    filled = np.isfinite(high[:, 0])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for every cell that may hold one of its best k."""
        for batch in batches:
            out = []
            for query_id, v, d in zip(batch["vec_id"], batch["v"], batch["d"], strict=True):
                v, d = np.asarray(v), np.asarray(d)
                known = {}  # one score for each id, as in the result
                for i, x in drawn:
                    if i != query_id and len(x) == len(v):
                        known[i] = max(known.get(i, -LONG - 1), int(inner_products(x[None], v)[0]))
                least = sorted(known.values())[-k] if len(known) >= k else -LONG - 1
                square = (v**2).sum()
                bound = np.maximum(np.maximum(low[:, :-1] - d, d - high[:, :-1]), 0).max(axis=1)
                best = (square + high[:, -1] - bound**2) / 2
                for cell in np.flatnonzero(filled & (best + slack(square + high[:, -1]) >= least)):
                    out.append((int(cell), query_id, v, d, least))
            yield pd.DataFrame(out, columns=["cell", "query_id", "v", "d", "least"])

    queries = table.where(query_ids(F.col("vec_id"))).mapInPandas(route, "cell int, query_id long, v array<double>, d array<double>, least long")

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in left.groupby(left["v"].map(len)):
            x, dx, ids = np.array(part["v"].tolist()), np.array(part["d"].tolist()), part["vec_id"].to_numpy()
            squares = (x**2).sum(axis=1)
            for query_id, v, d, least in zip(right["query_id"], right["v"], right["d"], right["least"], strict=True):
                if len(v) != dim:
                    continue
                v = np.asarray(v)
                square = (v**2).sum()
                bound = np.abs(dx - np.asarray(d)).max(axis=1)
                best = (square + squares - bound**2) / 2 + slack(square + squares)
                out += evaluate(query_id, v, x, ids, best, least, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search(table.select("cell", "vec_id", "v", "d"), queries, n_cells, kernel, k, largest=True, score="long")


def slack(size):
    """Room for the rounding of distances in a bound on scores up to `size`."""
    return 1.0 + 1e-9 * size


def evaluate(query_id: int, v: np.ndarray, x: np.ndarray, ids: np.ndarray, best: np.ndarray, least: int, k: int, step: int = 128) -> list[tuple[int, int, int]]:
    """The block's best k of one query: candidates in bound order, until no bound reaches the k-th score."""
    order = np.argsort(-best, kind="stable")
    found: dict[int, int] = {}
    for start in range(0, len(order), step):
        if best[order[start]] < least:
            break
        part = order[start:start + step]
        for i, s in zip(ids[part].tolist(), inner_products(x[part], v).tolist(), strict=True):
            if i != query_id and s >= least:
                found[i] = max(s, found.get(i, s))
        if len(found) >= k:
            top = sorted(found.items(), key=lambda t: (-t[1], t[0]))[:k]
            found, least = dict(top), max(least, top[-1][1])
    return [(query_id, i, s) for i, s in sorted(found.items(), key=lambda t: (-t[1], t[0]))[:k]]
