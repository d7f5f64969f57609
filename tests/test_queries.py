"""Every query with SQL against DuckDB on the smallest tables; the others have rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for m in entry.MODULES for k, f in m.QUERIES.items()}
SQL = {k: f for m in entry.MODULES for k, f in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in SQL:
        assert df.columns
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["x"]


def test_checks_of_themselves(spark):
    assert all(r.same for r in QUERIES["sparql_roundtrip"](spark, SF).collect())
    how = {r.relation: r.how for r in QUERIES["ground_fuzzy"](spark, SF).collect()}
    assert how["trade.order.lines"] == "exact" and how["trade.ordr.customer"] == "fuzzy" and how["xx.yy.balance"] == "suffix"


def test_samples_verify(spark):
    rows = QUERIES["verify_samples"](spark, SF).collect()
    # an earliest or latest answer need not be the fact's own; a plain join always has it among its answers
    simple = [r for r in rows if "-simple_" in r.sample_id]
    assert simple and all(r.verified for r in simple) and {r.verification_error for r in rows if not r.verified} == {"answer_mismatch"}
