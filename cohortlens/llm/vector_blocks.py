"""Blocks of vectors and of queries for searches by many queries over many rows.

A search routes rows and queries to cells (a pivot's cell, a bucket of a hash table).  A cell
is dealt by a hash of the id into blocks of about BLOCK rows and its queries into blocks of
about QUERIES, from the counts of the cells, so that no task ever holds a whole cell however
hot it is; a row is repeated once for each query block of its cell.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 1024, 512


def usable(vector: str, nonzero: bool = False) -> Column:
    """Not null or empty, every component finite (and one of them not zero, if asked for)."""
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.coalesce(ok, F.lit(False))
    return ok & F.exists(v, lambda x: x != 0) if nonzero else ok


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def search(
    rows: DataFrame, queries: DataFrame, cells: int, kernel: Callable, k: int, largest: bool, score: str, block: int = BLOCK, query_block: int = QUERIES,
) -> DataFrame:
    """Best k rows of each query over all cells that it visits: query_id, rank, vec_id, score.

    `rows` has cell, vec_id and what the kernel needs; `queries` cell, query_id and the same.
    kernel(rows, queries) gives query_id, vec_id, score with each query's best k of one block.
    Cells are numbered below `cells`, so that many counts are gathered on the driver.
    """
    n_rows, n_queries = np.ones(cells, dtype=int), np.ones(cells, dtype=int)
    for at, df, most in ((n_rows, rows, block), (n_queries, queries, query_block)):
        for r in df.groupBy("cell").count().collect():
            at[r["cell"]] = -(-r["count"] // most)
    count = lambda at: F.element_at(F.lit(at.tolist()), F.col("cell") + 1)
    deal = lambda name, at: F.pmod(F.xxhash64(F.lit("block"), name), count(at).cast("long")).cast("int")
    every = lambda at: F.explode(F.sequence(F.lit(0), count(at).cast("int") - 1))
    a = rows.withColumn("_b", deal("vec_id", n_rows)).withColumn("_q", every(n_queries))
    b = queries.withColumn("_q", deal("query_id", n_queries)).withColumn("_b", every(n_rows))
    keys = ("cell", "_b", "_q")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return kernel(left, right)

    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    best = found.groupBy("query_id", "vec_id").agg((F.max if largest else F.min)("score").alias("score"))
    order = F.desc("score") if largest else F.asc("score")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
