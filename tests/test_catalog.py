"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from textweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def cells(rows):
    """Rows in order; numbers to nine places, as results are rounded to six at most."""
    return sorted((tuple(round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = [tuple(r[c] for c in names) for r in df.collect()]
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == names
    theirs = duck.sql(f"SELECT {', '.join(names)} FROM ({catalog.SQL[name]})").fetchall()
    assert cells(ours) == cells(theirs)


@pytest.mark.parametrize("turn", [1, -1])
def test_ordered_dedupe_on_equal_orders(spark, tmp_path, turn):
    """Rows of one key and order count by their flag, in whatever order they lie."""
    con = duckdb.connect()
    rows = [(1, 7, 1, "R"), (1, 7, 1, "A"), (1, 7, 2, "A"), (2, 9, 1, "N"), (2, 9, 1, None), (3, 5, 4, "B"), (3, 5, 3, "C")][::turn]
    con.sql("CREATE TABLE lineitem (l_partkey BIGINT, l_orderkey BIGINT, l_linenumber INTEGER, l_returnflag VARCHAR)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", rows)
    con.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    ours = catalog.QUERIES["ordered_dedupe"](spark, str(tmp_path)).select("l_partkey", "id", "l_returnflag").collect()
    theirs = con.sql(f"SELECT l_partkey, id, l_returnflag FROM ({catalog.SQL['ordered_dedupe']})").fetchall()
    assert sorted(map(tuple, ours), key=repr) == sorted(theirs, key=repr) == [(1, 71, "A"), (2, 91, None), (3, 53, "C")]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
