"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import decimal
import math

import pytest

from kestrelgrid.plans import load

from .conftest import SF


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    return str(value)


def rows_of(rows, names, wanted):
    order = [names.index(c) for c in wanted]
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, q in load().items() if q.sql))
def test_same_rows_as_sql(name, spark, duck):
    query = load()[name]
    df = query(spark, SF)
    expected = duck.sql(query.sql)
    assert sorted(df.columns) == sorted(expected.columns)
    wanted = sorted(df.columns)
    assert rows_of(df.collect(), df.columns, wanted) == rows_of(expected.fetchall(), expected.columns, wanted)


@pytest.mark.parametrize("name", sorted(n for n, q in load().items() if not q.sql))
def test_runs_without_sql(name, spark):
    assert load()[name](spark, SF).count() >= 0


def test_ids_are_known():
    assert all(q.ids for q in load().values())
