"""A few queries against DuckDB on the smallest tables; the driver runs them all."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_engine_query_has_sql():
    from cellgauge import oracle, queries

    assert set(queries.QUERIES) == set(oracle.oracle_sql())


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", ["quality_towers", "rejection_reason_summary", "dedup_latest", "scd2_dimension", "tower_daily_kpis", "q15_investigate_first"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
