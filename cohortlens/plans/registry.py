"""Registry of named jobs: name -> (spark builder, oracle SQL or None)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def rounded(df: DataFrame, nd: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column (both sides of the oracle check do this)."""
    out = {
        f.name: F.round(F.col(f.name), nd)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(out) if out else df
