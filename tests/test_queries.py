"""Registered queries beside their checking SQL.  FREIGHTAUDIT_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from freightaudit.bindings.views import TABLES
from scripts.check_queries import canonical

SF = "/root/testdata/sf0.001"
QUICK = ["audit_mails", "classify_label", "cascade", "final_score", "meta_tfidf", "stream_triage"]
NAMES = list(entry.oracle_sql()) if os.environ.get("FREIGHTAUDIT_ALL") else QUICK


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, checker, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in frame.collect())
    result = checker.execute(entry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    places = [order.index(c) for c in columns]
    assert got == sorted(tuple(canonical(r[i]) for i in places) for r in result.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
