"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from corpusloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    answer = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in answer.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_no_python_in_plans(spark, small):
    """No query outside the training-data operators needs Python on the executors."""
    for name, make in registry.QUERIES.items():
        if name == "exclude_set" or name == "doc_closure":
            continue
        plan = make(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_path", "reason", "triggers", "strength"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
