"""Every registered query of the engine runs; those with SQL give the rows that DuckDB gives."""

import decimal
import glob
import os

import duckdb
import pytest

from tidewright.plans import catalog, registry

assert catalog.MODULES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6))
    return v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, data, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    cur = con.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall()) == rows


def test_entry(spark, data):
    assert catalog.flagship(spark, data).count() > 0
