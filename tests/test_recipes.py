"""Smoke runs of the faster end-to-end recipes on the smallest data."""

import pytest

import __spark_entry__ as se

from conftest import SF_SMALL


@pytest.mark.parametrize("name", ["z1_profile_report", "z5_woe_scorecard", "z6_score_blend",
                                  "z8_pairwise_target_table"])
def test_recipe_runs(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["z3_group_feature_table", "z6_score_blend", "z9_undersampled_voting"])
def test_result_reads_written_rows_not_the_inputs_again(spark, name):
    plan = se.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "FileScan" not in plan
