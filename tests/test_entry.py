"""The driver's contract, and queries against their oracles on the smallest tables."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pelgrain.plans.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "n_ink", "n_pixels", "line_art"] and df.count() == 500


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_data_operators(tmp_path):
    """What remains when that subpackage and its pipeline are gone still imports and lists its queries."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1]); sys.modules['pelgrain.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'q20_adaptive_ink_ratio' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code, str(ROOT)], check=True, cwd=tmp_path)


def test_nothing_outside_imports_the_subpackage():
    for f in (ROOT / "pelgrain").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "pelgrain.llm" not in f.read_text(), f
