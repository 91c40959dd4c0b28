from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from linehaul.plans.oracle import ORACLE
from linehaul.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["id", "ts", "speed"] and df.count() > 0


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": SF, "BENCH_CPUS": "2", "BENCH_QUERIES": "relay_key_value"}
    run = subprocess.run(
        [sys.executable, str(ROOT / "bench.py")],
        env=env, capture_output=True, text=True, timeout=300, check=True,
    )
    result = json.loads(run.stdout.strip())
    assert result["sf"] == "0.001" and list(result["queries"]) == ["relay_key_value"]


def test_lost_tasks_change_nothing(tmp_path):
    run = subprocess.run(
        [sys.executable, str(ROOT / "tests" / "retry_check.py"), str(tmp_path)],
        capture_output=True, text=True, timeout=300,
    )
    assert run.stdout.strip() == "all rows once", run.stderr[-2000:]
