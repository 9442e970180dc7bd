"""Every registered query against its SQL twin, and rules all their plans must keep."""

from __future__ import annotations

import pytest
from compare import compare

import __spark_entry__ as contract
from hazegrid.catalog import all_oracles, all_queries
from conftest import plan_of

# Queries of the training-data part have tests of their own.
QUERIES = {name: f for name, f in contract.queries().items() if name in all_queries()}
ORACLES = all_oracles()
# The slowest fit of all; covered by test_plans.
SLOW = {"j8_profile_comparison"}


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in SLOW])
def test_query(spark, folder, duck, name):
    problem, _ = compare(spark, duck, folder, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem


def test_every_query_has_its_twin():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


PLAIN = [name for name in QUERIES if name[0] in "abcdefgh"]


def test_no_plan_pairs_all_rows(spark, folder):
    for name in PLAIN:
        plan = plan_of(QUERIES[name](spark, folder))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_site_scan_reaches_the_file(spark, folder):
    plan = plan_of(QUERIES["a5_scan_site"](spark, folder))
    assert "EqualTo(event_type,view)" in plan
    assert "user_id" not in plan.split("ReadSchema")[-1]


def test_top_rows_are_cut_before_the_shuffle(spark, folder):
    physical = plan_of(QUERIES["f2_history_tail"](spark, folder)).split("== Physical Plan ==")[-1]
    assert physical.count("WindowGroupLimit") == 4
    assert "Partial" in physical
