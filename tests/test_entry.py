import importlib.util
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textlake import queries

ROOT = Path(entry.__file__).parent
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def plain(rows):
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v + 0:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, (cell(v) for v in row))) for row in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    found = oracle.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == plain([tuple(row[i] for i in order) for row in found.fetchall()])


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


@needs_data
def test_counts_are_combined_before_their_shuffle(spark):
    from textlake.plans import exchanges, physical_plan

    df = queries.queries()["bigram_freqs"](spark, DATA)
    plan = physical_plan(df)
    assert exchanges(df) == 1 and "partial_count" in plan and "ReadSchema: struct<text:string>" in plan


def test_imports_without_the_subpackage(tmp_path):
    for name in ("textlake", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "textlake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert not e.HAS_LLM; q = e.queries(); assert q and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_core_does_not_use_the_subpackage():
    for path in (ROOT / "textlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.util.find_spec("textlake.queries")
