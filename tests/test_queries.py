"""Every query with SQL equals DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

from melisma.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool | str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(float(v), 5)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    rel = con.execute(registry.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= (name != "intent_clauses")  # few prompts ask for anything
