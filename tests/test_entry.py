"""Driver contract: entry, registry and the DuckDB oracles (at sf0.001)."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

from conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    rows = entry(spark).collect()
    assert {r["dimension"] for r in rows} >= {"overall", "completeness"}


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sp = queries()[name](spark, SF001).toPandas()
    dd = duck.sql(oracle_sql()[name]).df()
    sc, sr = _rows(sp)
    dc, dr = _rows(dd)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
