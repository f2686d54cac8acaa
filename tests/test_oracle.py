"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import datetime as dt
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
import sql_oracle
from conftest import SF0001
from cxpulse.plans.catalog import QUERIES as CORE

TABLES = ["events", "benchmark", "documents", "labels", "conversations"]
QUERIES = {k: v for k, v in E.queries().items() if k in CORE}
SQL = sql_oracle.oracle_sql()


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF0001, t + '.parquet')}')")
    return con


def test_every_query_has_oracle_or_is_iterative():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"emerging_topics", "document_model_labels", "document_recovery"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 30
    assert {str(r.date) for r in rows if r.is_spike} == {"2024-01-15", "2024-01-24", "2024-01-25", "2024-01-28"}
