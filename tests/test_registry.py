"""Every registered query against its SQL on the smallest tables."""

import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in sorted(pathlib.Path(SF).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
