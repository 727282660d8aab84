"""Every query runs on the smallest tables, and agrees with its SQL where it has any."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from folioflow.plans.base import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in SQL:
        cur = db.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
        assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
