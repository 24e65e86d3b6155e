"""Every registered plan equals its independent DuckDB oracle (sf0.001)."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql
from adlens.plans.registry import REGISTRY
from conftest import SMOKE_DIR
from tools.check_oracle import _rows, duck

#: Estimates have no SQL; test_reach.py holds them against exact counts.
ESTIMATES = {"estimated_reach_by_window"}
NAMES = sorted(set(REGISTRY) - ESTIMATES)


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE_DIR)


def test_every_plan_has_an_oracle():
    assert set(NAMES) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="test data missing")
@pytest.mark.parametrize("name", NAMES)
def test_plan_matches_oracle(spark, con, name):
    sdf = REGISTRY[name](spark, SMOKE_DIR)
    rel = con.sql(oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["avg_display_per_user_per_day", "sum_displays", "sum_clicks", "sum_sales", "rev"]
    assert df.count() >= 0
