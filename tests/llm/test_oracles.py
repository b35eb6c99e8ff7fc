"""Queries against their oracles on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pelgrain.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=str)
