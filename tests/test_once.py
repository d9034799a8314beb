"""Filters read what was computed below them; none holds a copy of the computation."""

import pytest

from plateworks.plans import load


@pytest.mark.parametrize("name", ["win_category_share", "win_brand_first", "rdy_brands_in_metadata"])
def test_no_filter_matches_patterns_again(spark, name):
    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    again = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith(("Filter ", "Join ")) and "RLIKE" in line]
    assert "RLIKE" in plan and not again
