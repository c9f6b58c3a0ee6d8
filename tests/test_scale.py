"""Shuffles, passes and fits that large tables can't afford."""

import re

import pytest

import __spark_entry__ as entry
import tenuro as t
from tests.tables import AS_OF, rows_of
from tests.test_plans import SF, plan_of, stored  # noqa: F401


def test_the_dataset_moves_numbers_of_raw_usage_once(conf, stored):  # noqa: F811
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(t.prediction_dataset(bought, used, AS_OF))
    # The bitmap filters raw usage, and the exact join meets one row per team.
    assert "_place" not in plan and "BroadcastHashJoin [_word" in plan
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*), 4\)", plan)]
    usage = [k for k in keys if "month" in k or "event_date" in k]
    assert usage == ["team_id, year, month, seen", "team_id, year, month, user_id"]
    assert plan.count("partial_avg") == 1  # the average repurchase time


@pytest.mark.parametrize("keep", ["activity", "licenses"])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_the_dataset_has_the_figures_of_each_step(conf, stored, keep, threshold):  # noqa: F811
    bought, used = stored
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    dataset = t.prediction_dataset(bought, used, AS_OF, keep=keep)
    apart = t.team_monthly_average(used, bought).join(t.team_totals(used, bought), "team_id")
    with_usage = dataset.join(apart.select("team_id"), "team_id", "left_semi")
    assert rows_of(with_usage.select(*apart.columns)) == rows_of(apart)
    teams = apart if keep == "activity" else t.license_teams(bought)
    assert dataset.count() == teams.count()


SMALL_MODELS = (
    "stump_scores", "stump_scores_target2", "stump_report", "exact_stump_scores",
    "tree_scores_in_batches", "boosted_stump", "boosted_rounds", "logistic_share",
)


@pytest.mark.parametrize("name", SMALL_MODELS)
def test_models_score_a_dataset_computed_once(spark, name):
    files = entry.core_queries()[name](spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
