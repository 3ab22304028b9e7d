"""Months come from the orders that are there."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["months", "search_months"])
@pytest.mark.parametrize("days", [[(2023, 11, 30), (2024, 2, 1), (2024, 2, 9)], []])
def test_months_of_orders(spark, tmp_path, name, days):
    rows = [(i, dt.datetime(*x)) for i, x in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view orders as select o_orderkey, o_orderdate::timestamp as o_orderdate from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert len(want) == (0 if not days else 4 if name == "months" else 2 * (2 + 3 + 2 + 3))
