"""Every registered query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from jobloom.plans import queries as q


def norm(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, sf, db, name):
    got = q.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cur = db.execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(norm(r[c]) for c in cols) for r in got.collect()) == want


def test_entry_and_contract(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
    assert e.entry(spark).count() > 0
    assert q.cron_next(spark, sf).count() == len(q.SCHEDULERS) == q.scheduler_fire(spark, sf).count()
