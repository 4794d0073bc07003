"""A folder of uploads in several dialects (O-07, O-116): one table, and what its columns are good for.

The first lines of every file are taken in the scan (Spark keeps `sample` lines of each file per task); a
small helper finds each file's delimiter in them.  Files with the same delimiter and header line are
read together by Spark's CSV reader, and the groups are united by column name.

Defined results: every column is text; a column that a file lacks is NULL in its rows; repeated names in
a header become unique as in `read_upload`; a file without lines gives nothing, one with a header alone only its
columns; an empty folder gives a table without columns; a byte order mark goes; a short row ends in NULLs; the files
may lie in subfolders.  A header that already has the name of `file_col` is an error.
"""
from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intake import dedupe_names, detect_roles, infer_types, readiness, sniff_delimiter


def _dialect(rows):
    """(file, sep, header) of the first lines of one file."""
    lines = list(rows.sort_values("n")["value"])
    return rows.head(1)[["file"]].assign(sep=sniff_delimiter([x.lstrip("﻿") for x in lines]), header=lines[0].lstrip("﻿"))


def dialects(spark: SparkSession, path: str, sample: int = 20) -> DataFrame:
    """(file, sep, header line) of every file with a line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    first = F.row_number().over(Window.partitionBy("file").orderBy("start", "at"))  # a task reads a block in its order
    head = lines.withColumn("n", first).where(F.col("n") <= sample)
    # one group is at most `sample` lines
    return head.groupBy("file").applyInPandas(_ship_free(_dialect), "file string, sep string, header string")


def _ship_free(fn):
    """The helper with what it needs bound by value, so that executors need not have this package installed."""
    from pyspark import cloudpickle
    import sys

    for name in (__name__, sniff_delimiter.__module__):
        cloudpickle.register_pickle_by_value(sys.modules[name])
    return fn


def read_folder(spark: SparkSession, path: str, sample: int = 20, multi_line: bool = False, file_col: str | None = "upload_file") -> DataFrame:
    """All files below `path` as one table of texts, with the file of each row in `file_col`."""
    groups: dict[tuple, list[str]] = {}
    for r in dialects(spark, path, sample).collect():  # one small row per file, as in Spark's own file listing
        groups.setdefault((r["sep"], r["header"]), []).append(r["file"])
    parts = []
    for (sep, header), files in sorted(groups.items()):
        names = dedupe_names([c.strip() for c in next(csv.reader([header], delimiter=sep), [])])
        if file_col in names:
            raise ValueError(f"a file has a column named {file_col}")
        rows = (spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names]))
                .option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", "UTF-8")
                .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(sorted(files)))
        parts.append(rows.withColumn(file_col, F.col("_metadata.file_path")) if file_col else rows)
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return table.select(*[F.col(f"`{c}`") for c in table.columns if c != file_col], *([file_col] if file_col else []))


def upload_overview(df: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """One row per column: its type (O-116), its role among `known` (NULL: none), whether another column had claimed
    that role before, and the readiness flags of the table."""
    roles, repeated = detect_roles(df.columns, known)
    flags = readiness(df.count(), len(df.columns), len(roles))
    names = [(c, roles.get(c), c in repeated) for c in df.columns]
    told = df.sparkSession.createDataFrame(names, "column_name string, role string, repeated boolean")
    return infer_types(df).join(told, "column_name", "left").withColumns({k: F.lit(v) for k, v in flags.items()})
