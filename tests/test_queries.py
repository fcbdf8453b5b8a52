"""Every core query that has SQL against it on the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import TABLES, compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tabulith.catalog import all_sql  # noqa: E402

QUERIES, SQL = entry.queries(), all_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    result = compare(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())
    spark.catalog.clearCache()
    assert result.startswith("ok"), result


def test_entry(spark):
    rows = {r["item"]: r["value"] for r in entry.entry(spark).collect()}
    assert 0 < rows["accuracy"] <= 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(QUERIES)
