"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.6f}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", ["metrics_segments", "metrics_text", "statfs"])
def test_large_numbers_against_sql(spark, duck, tmp_path, name):
    """Few events with large ids and values."""
    rows = "SELECT 500000000 + 1700 * i AS event_id, 7 * i AS user_id, ['click', 'view', 'error'][i % 3 + 1] AS event_type, 1.23e13 * (i + 1) AS value FROM range(20) t(i)"
    con = duck.cursor()
    con.execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(cursor.fetchall())
    assert expected and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
