"""The registered queries: oracles belong to queries, a few are run against DuckDB, and the
library stands without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from panelyard import plans

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
SAMPLE = ["j1_transitions", "a5_exit_frame", "a3_edge_bins", "j5_forward_returns", "e6_path_between", "r1_bootstrap_median", "r6_clustered_shuffle_by_year", "j16_matched_controls", "v9_firm_basis", "n4_name_match", "v13_company_facts", "v15_shapley"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "k", "at_risk", "failures", "incidence"] and df.count() > 0


def _plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.7g}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = plans.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(_plain, r)) for r in want.fetchall())


def test_library_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
