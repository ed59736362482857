import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from barograph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, dt.date) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_has_one_row_per_asset(spark):
    rows = entry.entry(spark).collect()
    assert {r["asset_key"] for r in rows} == {"A", "N", "R"}
    assert all(r["regime"] in ("Low", "Normal", "High") for r in rows)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)
