"""Every query beside its SQL twin at the smallest scale."""

import importlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from verify import canonical

DATA = "/root/testdata/sf0.001"
REGISTRIES = [importlib.import_module(m).REG for m in entry.MODULES]
QUERIES = {k: q for r in REGISTRIES for k, q in r.queries.items()}
ORACLES = {k: q for r in REGISTRIES for k, q in r.oracles.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = canonical(QUERIES[name](spark, DATA).toPandas())
    rel = con.sql(ORACLES[name])
    want = canonical(pd.DataFrame(rel.fetchall(), columns=rel.columns))
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    differing = (got != want).any(axis=1)
    assert not differing.any(), pd.concat([got[differing].head(), want[differing].head()]).to_string()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_readable_without_session():
    assert set(entry.oracle_sql()) <= set(entry.queries())
