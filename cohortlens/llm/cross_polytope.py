"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

In each table a vector, scaled to length one, goes through a pseudo-random rotation (three
rounds of random signs and a fast Hadamard transform, in the next power of two of its length)
and falls into the bucket of the nearest signed axis.  A query visits the buckets of its `probes`
nearest signed axes in each of the `tables` tables; every row there is ranked by its exact
Euclidean distance.  No bucket is capped: large ones are dealt into blocks (vector_blocks.py).
Every row is indexed and nothing is fitted, so results don't depend on a sample.  Queries that found
fewer than k rows are ranked against all rows of their length.

Defined results: vectors that are null, empty or zero or hold a null or non-finite component
take no part, nor do rows with a null id; vectors of different lengths are not compared; rows of
one id are one candidate (its smallest distance), and a query never meets a row of its own id;
ties go to the smaller vec_id; fewer than k rows of its length give them all; other columns of the
input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vector_blocks import search, usable

SPREAD = 256  # buckets of one table; longer vectors' axes are folded onto them


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signed_axes(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Products of each vector with the 2 d signed axes of one table's rotation."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table, d]).choice([-1.0, 1.0], size=(3, d))
    for s in signs:
        x = hadamard(x * s)
    return np.hstack([x, -x])


def buckets(vectors: list[np.ndarray], tables: int, probes: int, seed: int) -> list[np.ndarray]:
    """For every vector its cells (table * SPREAD + bucket): `probes` of each table, nearest axis first."""
    out: list = [None] * len(vectors)
    lengths = np.array([len(v) for v in vectors])
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        x = np.array([vectors[i] for i in at], dtype=np.float64)
        cells = []
        for t in range(tables):
            dots = signed_axes(x, t, seed)
            m = min(probes, dots.shape[1])
            near = np.argsort(-dots, axis=1, kind="stable")[:, :m]
            cells.append(t * SPREAD + near % SPREAD)
        joined = np.hstack(cells)
        for i, row in zip(at, joined, strict=True):
            out[i] = np.unique(row) if probes > 1 else row
    return out


def nearest(
    vectors: DataFrame, query_ids, k: int = 10, tables: int = 10, probes: int = 10, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows found for each query."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable("v", nonzero=True) & F.col("vec_id").isNotNull())

    def hashed(df: DataFrame, n: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(cells=pd.Series(buckets(batch["v"].tolist(), tables, n, seed), index=batch.index, dtype=object))

        return df.mapInPandas(run, "vec_id long, v array<double>, cells array<int>").select(F.explode("cells").alias("cell"), "vec_id", "v")

    asked = rows.where(query_ids(F.col("vec_id")))
    table = hashed(rows, 1)
    queries = hashed(asked, probes).withColumnRenamed("vec_id", "query_id")

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in left.groupby(left["v"].map(len)):
            x, ids = np.array(part["v"].tolist()), part["vec_id"].to_numpy()
            for query_id, v in zip(right["query_id"], right["v"], strict=True):
                if len(v) != dim:
                    continue
                dist = np.sqrt(((x - np.asarray(v)) ** 2).sum(axis=1))
                found = {}
                for j in np.lexsort((ids, dist)):
                    i = int(ids[j])
                    if i != query_id and i not in found:
                        found[i] = float(dist[j])
                        if len(found) == k:
                            break
                out += [(query_id, i, d) for i, d in found.items()]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = materialise(search(table, queries, tables * SPREAD, kernel, k, largest=False, score="double"), "neighbours")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    short = materialise(short, "short-queries")
    length = F.size("v").alias("n")
    alike = rows.withColumn("n", length).join(short.select(length).distinct(), "n", "left_semi")  # only rows of the lengths that came short
    cell = (length % SPREAD).alias("cell")
    more = search(alike.select(cell, "vec_id", "v"), short.select(cell, F.col("vec_id").alias("query_id"), "v"), SPREAD, kernel, k, largest=False, score="double")
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(more)
