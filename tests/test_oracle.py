"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillmark.queries import core

Q, SQL = core.queries(), core.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") if v == v else "nan"
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


def test_every_sql_has_a_query():
    assert not set(SQL) - set(Q)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, con, name):
    df = Q[name](spark, small)
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert got == want
