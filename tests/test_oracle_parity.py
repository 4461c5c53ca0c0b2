"""Every registered query equals its DuckDB oracle (sf0.001 here; the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_compare import compare
from workboard.plans import registry
from workboard.plans.oracle import ORACLE

NAMES = sorted(registry.queries())


def test_every_query_has_oracle():
    assert set(ORACLE) == set(NAMES)
    assert set(NAMES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, name):
    res = compare(spark, SF001, [name], verbose=False)[name]
    assert res.get("match") is True, res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "name", "email", "job_role", "created_at", "project_count",
                          "assigned_task_count", "completed_task_count"]
