"""The driver contract: names, columns and a few whole comparisons on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["price_track", "list_components", "neighbours", "match_reason", "triage", "quality_candidates", "carry_forward"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from gearledger.catalogue_queries.shapes import TABLES
    from tools.check_queries import rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
