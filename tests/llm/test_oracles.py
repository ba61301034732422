"""The llm queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    df = queries.QUERIES[name](spark, small)
    names = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    answer = con.execute(queries.ORACLES[name])
    at = [[c[0] for c in answer.description].index(c) for c in names]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in answer.fetchall()), key=repr)
