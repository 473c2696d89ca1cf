"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op")}


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 6) if isinstance(value, float) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, engine, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    result = engine.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, result.fetchall())


def test_size_display_large_and_halves(spark, tmp_path):
    """Sizes of a GB and more, half bytes, borders of the units, negative ones and nulls."""
    part = [(1, x) for x in (0.05, 0.15, 0.25, -0.05, -0.15, 102.35, 102.4, 128.0, 104857.55, 104857.6, 107374182.35, 107374182.4, 1e16, -1e17, None)]
    part += [(-1, 102400.0), (107947, 994.7), (1199999, 999.9), (10**12, 900.1), (None, 5.0)]
    spark.createDataFrame(part, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    result = con.execute(SQL["size_display"])
    columns = [d[0] for d in result.description]
    df = __spark_entry__.queries()["size_display"](spark, str(tmp_path))
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
