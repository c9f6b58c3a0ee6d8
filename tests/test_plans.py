"""The shape of the physical plans, and data with one very busy team."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import tenuro as t
from tenuro.functions import watch_dates
from tenuro.operators import activity
from tenuro.schema import MEASURES
from tests.tables import AS_OF, licenses, rows_of

SF = "/root/testdata/sf0.001"
MODELS = {
    "grid_search", "grid_search_target2", "grid_search_logistic",
    "grid_search_boosted", "feature_importance_ranked", "feature_importance_top8",
    "test_predictions", "test_report", "churn_probability", "stump_scores",
    "stump_scores_target2", "stump_importance", "stump_report", "stump_search",
    "stump_search_target2", "boosted_stump", "logistic_share", "tree_search",
    "tree_search_target2", "tree_scores_in_batches", "tree_node_importance",
    "exact_stump_scores", "boosted_rounds", "forest_node_importance",
    "churn_probability_in_batches",
}


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A third of the rows belong to team 7, and most of its rows to user 0."""
    folder = tmp_path_factory.mktemp("skewed")
    n = F.col("id")
    hot = n % 3 == 0
    bought = spark.range(6000).select(
        n.alias("license_id"),
        F.when(hot, 7).otherwise(n % 500).alias("team_id"),
        F.date_sub(F.lit(AS_OF).cast("date"), (n % 700).cast("int"))
        .cast("string")
        .alias("license_start"),
        F.date_sub(F.lit(AS_OF).cast("date"), (n % 200).cast("int"))
        .cast("string")
        .alias("license_end"),
        F.lit("pro1").alias("plan"),
        (n % 4).alias("quantity"),
    )
    used = spark.range(30000).select(
        F.when(hot, 7).otherwise(n % 600).alias("team_id"),
        F.when(n % 5 != 0, n % 900).alias("user_id"),
        F.date_sub(F.lit(AS_OF).cast("date"), (n % 500).cast("int"))
        .cast("string")
        .alias("event_date"),
        *((n % (i + 2)).alias(m) for i, m in enumerate(MEASURES)),
    )
    for name, df in (("licenses", bought), ("activity", used)):
        df.write.parquet(f"{folder}/{name}")
    return tuple(spark.read.parquet(f"{folder}/{n}") for n in ("licenses", "activity"))


@pytest.mark.parametrize("name", sorted(entry.core_queries().keys() - MODELS))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(entry.core_queries()[name](spark, SF))
    for forbidden in ("Python", "CartesianProduct", "NestedLoopJoin", "InPandas"):
        assert forbidden not in plan


def test_scans_read_only_what_they_need(spark, conf, stored):
    bought, _ = stored
    conf("spark.sql.adaptive.enabled", "false")
    plan = plan_of(t.avg_repurchase(bought, AS_OF))
    assert "ReadSchema: struct<team_id:bigint,license_start:string>" in plan
    assert "IsNotNull(license_start), IsNotNull(team_id)" in plan


def test_one_scan_of_the_activity(spark, conf, stored):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    plan = plan_of(t.activity_features(used, bought))
    assert len(re.findall(r"ReadSchema: \S*event_date", plan)) == 1


def test_small_team_list_filters_at_the_scan(spark, conf, stored):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    plan = plan_of(t.activity_features(used, bought))
    semi = plan.index("LeftSemi")
    # Every shuffle of activity stands above the filter.
    assert len(re.findall(r"Exchange hashpartitioning", plan[:semi])) == 3
    assert "BroadcastHashJoin" in plan
    # Nothing is done to spread or to filter rows that a broadcast filters anyway.
    assert "_place" not in plan and "_held" not in plan and "Generate" not in plan[semi:]


PAID_USERS = (
    t.activity_features, t.team_month_usage, t.team_monthly_average, t.team_totals,
)


@pytest.mark.parametrize("operator", PAID_USERS)
def test_large_team_list_filters_raw_rows(spark, conf, stored, operator):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(operator(used, bought))
    # Every aggregation, and so every shuffle but the join's own, is above the filter.
    semi = plan.index("LeftSemi")
    assert "Exchange hashpartitioning" in plan[:semi]
    usage = plan[semi:]
    keys = re.sub(r"#\d+L?", "", "".join(re.findall(r"hashpartitioning\((.*?)\)", usage)))
    assert "_place" in keys and "month" not in keys
    # Before the shuffle of raw rows the bitmap has dropped most that aren't paid.
    scan = usage.index("Exchange hashpartitioning")
    assert "BroadcastHashJoin [_word" in usage[scan:] and "_held" in usage[scan:]


def test_bitmap_lets_all_paid_rows_pass_and_few_others(spark):
    teams = spark.range(0, 3000, 3).withColumnRenamed("id", "team_id")
    used = spark.range(-1, 3000).select(
        F.when(F.col("id") >= 0, F.col("id")).cast("int").alias("team_id"), F.lit(1).alias("a.b")
    )
    for bits in (6, 10, 24):
        passed = activity.maybe_paid(used, teams, bits)
        assert passed.columns == used.columns
        got = {r.team_id for r in passed.collect()}
        assert got >= set(range(0, 3000, 3))
        assert activity.team_bitmap(teams, bits).count() <= 1 << (bits - 6)
    assert len(got) <= 1010  # one in thousands by chance, and the rows without a team
    named = teams.select(F.concat(F.lit("t"), "team_id").alias("team_id"))
    assert activity.maybe_paid(named, named).count() == 1000
    as_text = used.withColumn("team_id", F.col("team_id").cast("string"))
    assert activity.maybe_paid(as_text, teams).where("team_id % 3 = 0").count() == 1000


@pytest.mark.parametrize("operator", [*PAID_USERS, t.monthly_overall])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_paid_first_changes_nothing_but_the_plan(spark, conf, stored, operator, threshold):
    bought, used = stored
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    first, last = (operator(used, bought, paid_first=p) for p in (True, False))
    rounded = [F.round(c, 6).alias(c) for c in first.columns]
    assert rows_of(first.select(rounded)) == rows_of(last.select(rounded))


def test_large_team_list_may_meet_aggregated_rows(spark, conf, stored):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(t.activity_features(used, bought, paid_first=False))
    keys = [
        re.sub(r"#\d+L?", "", k)
        for k in re.findall(r"Exchange hashpartitioning\((.*), 4\)", plan)
    ]
    # The join shuffles nothing but the list of teams: it uses the
    # distribution that the last aggregation of the activity left behind.
    assert keys == [
        "team_id",
        "team_id, year, month, seen",
        "team_id, year, month, user_id",
        "team_id",
    ]
    assert plan.index("LeftSemi") < plan.index("hashpartitioning")


def test_no_broadcast_of_the_dataset_sides_beyond_the_threshold(spark, conf, stored):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(t.prediction_dataset(bought, used, AS_OF))
    # The bitmap has a size of its own; no other side is broadcast.
    joins = re.findall(r"Broadcast\w+Join \[(\w+)#", plan)
    assert joins == ["_word"] and plan.count("SortMergeJoin") == 2
    assert "NestedLoop" not in plan


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_busy_team_gets_the_same_answer(spark, conf, stored, threshold):
    bought, used = stored
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    together = t.activity_features(used, bought)
    separate = t.team_monthly_average(used, bought).join(
        t.team_totals(used, bought), "team_id"
    )
    assert rows_of(together) == rows_of(separate, *together.columns)
    users = {
        n % 900 if n % 5 else 0 for n in range(30000) if n % 3 == 0 or n % 600 == 7
    }
    assert together.where("team_id = 7").first().user_id == len(users)
    assert t.paid_activity(used, bought).count() == used.where("team_id < 500").count()


def test_busy_team_is_split_where_raw_rows_are_joined(spark, conf, stored):
    bought, used = stored
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.2")
    conf("spark.sql.files.maxPartitionBytes", "10KB")
    paid = t.paid_activity(used, bought)
    assert len(paid.collect()) == used.where("team_id < 500").count()
    assert "SortMergeJoin(skew=true)" in plan_of(paid)


def test_only_global_aggregates_meet_in_one_partition(spark, conf, stored):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    plan = plan_of(t.prediction_dataset(bought, used, AS_OF))
    assert plan.count("SinglePartition") == 1  # the average repurchase time
    for operator in (t.purchase_sequence, t.repurchase_gaps, t.license_features):
        assert "SinglePartition" not in plan_of(operator(bought, AS_OF))


def test_repeat_buyers_shuffle_once_per_level(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    rows = licenses(spark, [(1, 1, "2020-01-01", "2020-07-01", "pro1", 2)])
    plan = plan_of(t.repurchase_gaps(rows, AS_OF))
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize(
    "operator, keys", [(t.exact_split, "_range"), (t.stratified_folds, "_by, _range")]
)
def test_exact_shares_move_the_rows_once(spark, conf, operator, keys):
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    teams = spark.range(100).select(
        F.col("id").alias("team_id"), (F.col("id") % 2).alias("Target1")
    )
    plan = re.sub(r"#\d+L?", "", plan_of(operator(teams)))
    # The rows once, the counts of their ranges once, and the offsets once.
    assert plan.count(f"Exchange hashpartitioning({keys}, 4)") == 3
    assert "Sort [team_id" not in plan and "rangepartitioning" not in plan


def test_bad_dates_of_dropped_rows_are_seen_in_the_same_scan(spark, conf, stored):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", "false")
    watch = watch_dates(used, "event_date")
    features = t.team_totals(watch.rows, bought)
    plan = plan_of(features)
    assert plan.count("CollectMetrics") == 1
    assert len(re.findall(r"ReadSchema: \S*event_date", plan)) == 1
    # No filter of the query itself comes before the counters.
    assert "isnotnull(team_id" not in plan[plan.index("CollectMetrics") :].split("Scan")[0]
    features.collect()
    assert watch.counts() == {"event_date": 0}
    watch.check()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_bad_date_without_a_team_raises(spark, conf, stored, adaptive):
    bought, used = stored
    conf("spark.sql.adaptive.enabled", adaptive)
    odd = spark.createDataFrame(
        [(None, "31-12-19"), (None, "2020-13-01"), (None, None), (3, "2020-1-5")],
        "team_id long, event_date string",
    )
    both = used.unionByName(odd, allowMissingColumns=True)
    t.team_totals(both, bought).collect()  # passes: the rows are dropped
    watch = watch_dates(both, "event_date")
    t.team_totals(watch.rows, bought).collect()
    assert watch.counts() == {"event_date": 2}
    with pytest.raises(ValueError, match="2 of event_date"):
        watch.check()
    with pytest.raises(ValueError, match="text"):
        watch_dates(spark.range(3), "id")
