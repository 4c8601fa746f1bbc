"""Every registered query equals its independently written DuckDB SQL (sf0.001)."""

import math

import pytest

import __spark_entry__ as E
from cadence.plans.registry import queries
from conftest import SMALL

QUERIES = queries()
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v))
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, repr(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def test_every_query_has_an_oracle_or_is_listed():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == [], missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[0] == "repository"
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    got, gcols = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[key])
    want, wcols = _rows([d[0] for d in cur.description], cur.fetchall())
    assert gcols == wcols
    assert len(got) == len(want)
    assert got == want
