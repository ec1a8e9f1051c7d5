"""What is registered: SQL twins, whole tables, and plans that hold up."""

import pytest

import __spark_entry__ as contract
from tidemark.config import Allowance, Registry, Source
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["source_id", "listing_id", "obs_id", "at_ms", "amount_minor_units", "reference_amount", "window_count"]
    assert df.count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["window_low_fired", "alert_status", "failure_rate_rolling", "hold_audit", "robots_decisions", "ceiling_audit"])
def test_no_pairs_of_everything(spark, name):
    plan = _plan(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_windows_are_cut_by_time(spark):
    plan = _plan(contract.queries()["window_low_fired"](spark, SMALL))
    wide = [line for line in plan.splitlines() if "Window [" in line and "_chunk" not in line]
    assert not wide


def test_only_the_needed_columns_are_read(spark):
    plan = _plan(contract.queries()["retention_counts"](spark, SMALL))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "l_extendedprice" not in scan and "l_comment" not in scan


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        Registry((Source("a"), Source("a")))
    assert Allowance(2000).warn_count == 1600
