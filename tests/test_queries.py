"""Every registered query against its SQL on the smallest tables; those without SQL give rows."""

import math

import pytest

from facetmill.plans import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr(tuple(norm(x) for x in r)) for r in got.fetchall())
    have = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
