"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder below the shared checkpoint folder and read it back.

    Cuts the lineage; the files outlive a lost executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """`materialise` in buckets of a key: joins on it read them where they lie, without a shuffle of these rows.

    There are as many buckets as shuffle partitions.  The files are below the shared checkpoint folder as others; the
    catalog holds their table only until it is read back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    named = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark allows no more
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(named)
    found = spark.table(named)
    spark.sql(f"DROP TABLE {named}")  # a table with a path keeps its files
    return found


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it.

    The zip file is staged on the driver for as long as its process lives; Spark's own file
    distribution does the rest.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        staging = tempfile.TemporaryDirectory(prefix=f"{root.name}-ship-")
        for p in root.rglob("*.py"):
            to = Path(staging.name, "src", root.name, p.relative_to(root))
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(p, to)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{staging.name}/{root.name}-tasks", "zip", f"{staging.name}/src"))
        _SHIPPED[app] = staging
