"""A changed source folder gives new results in the same session."""
import os
import shutil
import tempfile

from cohortlens.plans.curated import curated

SF = "/root/testdata/sf0.001"


def test_new_files_are_seen(spark):
    folder = tempfile.mkdtemp()
    for t in ("customer", "orders"):
        os.makedirs(f"{folder}/{t}.parquet")
        shutil.copyfile(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet/part-0.parquet")
    first = curated(spark, folder).count()
    assert curated(spark, folder).count() == first
    more = spark.read.parquet(f"{SF}/customer.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    more.withColumn("c_custkey", more["c_custkey"] + 10_000_000).coalesce(1).write.mode("append").parquet(f"{folder}/customer.parquet")
    orders.withColumns({"o_custkey": orders["o_custkey"] + 10_000_000, "o_orderkey": orders["o_orderkey"] + 10_000_000, "o_totalprice": orders["o_totalprice"] * 0.7 + 11}).coalesce(1).write.mode("append").parquet(f"{folder}/orders.parquet")
    assert curated(spark, folder).count() != first
