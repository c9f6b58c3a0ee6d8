"""Random tables against the plain-Python pipeline."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import tenuro as t
from tenuro.schema import MEASURES, PLAN_FAMILIES, TOTALS
from tests.tables import (
    AS_OF,
    activity,
    actual_dataset,
    expected_average,
    expected_dataset,
    licenses,
    rows_of,
)

few = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
team = st.one_of(st.none(), st.integers(0, 6))
date = st.one_of(
    st.none(),
    st.dates(
        min_value=datetime.date(2019, 1, 1),
        max_value=datetime.date(2021, 6, 1),
    ).map(str),
)
plan = st.one_of(st.none(), st.sampled_from([*PLAN_FAMILIES, "basic1", "edu1", "pro"]))
count = st.one_of(st.none(), st.integers(0, 9))
license_rows = st.lists(
    st.tuples(st.integers(0, 99), team, date, date, plan, count), max_size=40
)
activity_rows = st.lists(
    st.tuples(team, st.one_of(st.none(), st.integers(0, 4)), date, count), max_size=60
)


@few
@given(license_rows, activity_rows)
def test_dataset_matches_plain_python(spark, bought, used):
    dataset = t.prediction_dataset(licenses(spark, bought), activity(spark, used), AS_OF)
    expected = expected_dataset(bought, used)
    actual = actual_dataset(dataset)
    assert actual.keys() == expected.keys()
    for team_id, values in expected.items():
        assert actual[team_id][:2] == pytest.approx(values[:2])
        assert actual[team_id][2:] == values[2:]


@few
@given(license_rows)
def test_gaps_add_up_to_the_whole_span(spark, bought):
    rows = licenses(spark, bought)
    gaps = (
        t.repurchase_gaps(rows, AS_OF)
        .groupBy("team_id")
        .agg(F.sum("gap_days"), F.max("cum_seq") - 1)
    )
    spans = t.team_repurchase(rows, AS_OF)
    assert rows_of(gaps) == rows_of(spans, "team_id", "total_gap_days", "repurchases")
    assert t.avg_repurchase(rows, AS_OF).first()[0] == pytest.approx(
        expected_average(bought)
    )


@few
@given(license_rows, activity_rows)
def test_features_agree_with_the_separate_operators(spark, bought, used):
    events, owned = activity(spark, used), licenses(spark, bought)
    totals = t.team_totals(events, owned)
    separate = t.team_monthly_average(events, owned).join(totals, "team_id")
    together = t.activity_features(events, owned)
    assert rows_of(together) == rows_of(separate, *together.columns)
    months = t.team_month_usage(events, owned).groupBy("team_id")
    assert rows_of(months.agg(*(F.sum(m) for m in MEASURES))) == rows_of(
        totals, "team_id", *TOTALS[1:]
    )


@few
@given(license_rows, activity_rows)
def test_rows_without_a_team_change_nothing(spark, bought, used):
    extra = [(100, None, "2020-01-01", "2020-02-01", "pro1", 1)]
    usage = [(None, 1, "2020-01-01", 1)]
    assert rows_of(
        t.prediction_dataset(licenses(spark, bought), activity(spark, used), AS_OF)
    ) == rows_of(
        t.prediction_dataset(
            licenses(spark, bought + extra), activity(spark, used + usage), AS_OF
        )
    )
