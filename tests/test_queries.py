"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import decimal

import duckdb
import pytest

from maskwright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert got
        return
    found = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    at = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted(columns) == sorted(df.columns)
    assert got == want
