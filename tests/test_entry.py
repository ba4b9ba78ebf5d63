"""Driver contract: entry() smoke, registry consistency, oracle agreement at sf0.001."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from replaylab.plans import catalog

catalog._load_all()  # these tests cover the registry of plans/; the training-data operators have tests of their own

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if Path(p).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "artist_name", "total_streams", "total_minutes", "month", "month_rank"]
    assert df.count() > 0


def test_every_query_has_an_id_and_most_have_oracles():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(catalog.QUERIES) <= set(qs)
    qs = catalog.QUERIES
    assert len(qs) >= 80
    assert all(name[0] in "abcdefs" and name[1:3].isdigit() for name in qs)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle_agreement_small(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)
