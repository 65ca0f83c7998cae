"""The driver entry and, where the tables are there, queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["numbered_points", "transcript_segments", "usage_summary", "batch_validation", "canonical_urls"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{TABLES}/{f}')")
    got = entry.queries()[name](spark, TABLES)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    as_text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert as_text(got.select(*columns).collect()) == as_text(want.fetchall())
