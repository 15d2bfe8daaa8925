"""Every query with SQL returns what DuckDB returns on the same tables."""

import math

import pytest

from pathfold.plans import catalog


def rows(columns, data):
    """Rows with columns in the order of their names, floats last in the sorting and only roughly."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rough = lambda x: f"{x:.4g}" if isinstance(x, float) else ""
    exact = lambda x: "" if isinstance(x, float) else repr(x)
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: ([exact(x) for x in r], [rough(x) for x in r]))


def same(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-9) or math.isnan(x) and math.isnan(y))) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert same(rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect()
