"""Driver contract and the DuckDB oracle for every SQL-expressible job (sf0.01)."""
import duckdb
import pytest

import __spark_entry__ as E
from cohortlens.plans import ORACLE, QUERIES
from cohortlens.sources.tables import TABLES
from tools.check_oracle import canon

SF = "/root/testdata/sf0.01"
HEAVY = {"train_regression", "train_classifier", "custom_train_lineitem"}  # their functions run on small data in test_models.py


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == E.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - HEAVY))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0
