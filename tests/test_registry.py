import duckdb
import pytest

import __spark_entry__
from domgraph.plans import catalog
from domgraph.plans.facts import TABLES

FOLDER = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["risk_edges", "location_link", "matcher_chain", "overlay_merge", "manifest_diff", "conformance_expansion", "base_of"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=str) == sorted(want, key=str)
