"""Every query with SQL against DuckDB on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from docgraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(df):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 6)).removesuffix(".0")
        return str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if n != "pagerank_40"])
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_query_without_sql_returns_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_overrides_are_asked_of_every_part(spark):
    parts = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    bases = {c: {b for b, has in ((c // 2, c > 1 and c % 13), (c // 3, c > 2), (c + 1, c % 7 == 0)) if has and b in parts} for c in parts}
    want = set()
    for c in parts:
        above, open_ = set(), [c]
        while open_:
            more = bases[open_.pop()] - above
            above |= more
            open_ += more
        want |= {(b, f"m{b % 11}", c) for b in above - {c} if b % 11 == c % 11}
    got = [tuple(r) for r in registry.QUERIES["overridden_methods"](spark, SF).select("class", "name", "sub").collect()]
    assert sorted(got) == sorted(want) and {c % 8 for c, _, _ in got} == set(range(8))


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["doc_id", "score", "snippet"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
