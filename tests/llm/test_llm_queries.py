"""The subpackage's queries beside their SQL twins at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.llm.queries import REG
from verify import canonical

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(REG.queries))
def test_query(spark, name):
    got = REG.queries[name](spark, DATA).toPandas()
    if name not in REG.oracles:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(REG.oracles[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    assert canonical(got).equals(canonical(want))


def test_round_trip_restores_all(spark):
    assert all(r["not_restored"] == 0 for r in REG.queries["p6_round_trip"](spark, DATA).collect())
