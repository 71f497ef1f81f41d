"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from deliverix import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, query, sql):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = query(spark, DATA).toPandas(), c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for k in columns:
        if pd.api.types.is_numeric_dtype(b[k]) and not pd.api.types.is_bool_dtype(b[k]):  # whole numbers with nulls too
            assert np.allclose(*(x[k].to_numpy(float, na_value=np.nan) for x in (a, b)), rtol=1e-9, atol=1e-9, equal_nan=True), k
        else:
            assert (a[k].astype(object).fillna("").astype(str) == b[k].astype(object).fillna("").astype(str)).all(), k


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_registry(spark):
    from deliverix.plans import registry

    assert registry.choose("throughput_monthly") == ["throughput_monthly"]
    assert registry.choose()[0] == "cycle_time_monthly" and "cycle_time_by_branches" not in registry.choose()
    with pytest.raises(ValueError, match="one of"):
        registry.choose("velocity")


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy without their folders and the pipeline: the entry imports, all other tests are found, and some of each kind run."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tmp_path / "copy"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=to, env=env, check=True)
    tests = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    found = subprocess.run([*tests, "--collect-only", "tests"], cwd=to, env=env, capture_output=True, text=True)
    assert found.returncode == 0 and "test_distribution.py" in found.stdout and "error" not in found.stdout.lower()
    some = ["tests/test_streaming.py", "tests/test_sources.py::test_rules_of_an_interchange", "tests/test_graph.py::test_hidden_runs", "tests/test_distribution.py::test_ranks_of_ties", "tests/test_queries.py::test_against_sql[a2_throughput_monthly]"]
    subprocess.run([*tests, *some], cwd=to, env=env, check=True)
