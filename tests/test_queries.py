"""Every registered query of the library's own operators against its SQL in a second engine."""

import collections
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from quorumlab.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def second(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, second):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    found = second.sql(entry.oracle_sql()[name])
    names = list(found.columns)
    assert sorted(names) == sorted(df.columns)
    mine = collections.Counter(tuple(repr(plain(r[c])) for c in sorted(names)) for r in rows)
    theirs = collections.Counter(tuple(repr(plain(r[names.index(c)])) for c in sorted(names)) for r in found.fetchall())
    assert mine == theirs


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["task_id", "survival_label", "survival_score", "match_basis"] and rows.count() > 0
