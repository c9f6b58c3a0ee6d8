"""A hand-made case with known answers, and the cases it leaves out."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import tenuro as t
from tenuro.functions import (
    category_counts,
    count_bad_dates,
    discover_categories,
    four_digit_year,
    one_hot,
)
from tenuro.schema import DATASET, FEATURES, PLAN_COLUMNS
from tests.tables import (
    AS_OF,
    GOLDEN_ACTIVITY,
    GOLDEN_LICENSES,
    activity,
    actual_dataset,
    expected_average,
    expected_dataset,
    licenses,
    rows_of,
)


def test_prepared_licenses(golden_licenses):
    prepared = t.prepare_licenses(golden_licenses, AS_OF)
    assert prepared.columns == [
        "license_id",
        "team_id",
        "license_start",
        "license_end",
        "quantity",
        "license_end_recency",
        "license_start_recency",
        *PLAN_COLUMNS,
    ]
    rows = {r.license_id: r for r in prepared.collect()}
    assert 7 not in rows and len(rows) == 10
    assert rows[1].license_start == datetime.date(2020, 1, 1)
    assert (rows[1].license_start_recency, rows[4].license_end_recency) == (366, -59)
    assert rows[10].license_start_recency is None
    encoded = {i: tuple(r[c] for c in PLAN_COLUMNS) for i, r in rows.items()}
    assert encoded[1] == (0, 0, 0, 0, 1)
    assert encoded[5] == encoded[6] == encoded[11] == (0, 0, 0, 0, 0)


def test_plans_found_in_the_data(golden_licenses):
    recent = t.license_recency(golden_licenses, AS_OF)
    found = discover_categories(recent, "plan")
    assert found == [
        "academic", "basic1", "business", "edu", "edu1", "enterprise", "pro"
    ]
    encoded = t.prepare_licenses(golden_licenses, AS_OF, categories=found)
    assert encoded.columns[-7:] == [f"plan_{c}" for c in found]
    long = category_counts(recent, "team_id", "plan")
    wide = encoded.groupBy("team_id").agg(
        *(F.sum(f"plan_{c}").alias(c) for c in found)
    )
    expected = wide.unpivot("team_id", found, "plan", "n").where("n > 0")
    assert rows_of(long) == rows_of(expected)


def test_any_number_of_categories(spark):
    many = spark.range(3000).select(F.col("id").cast("string").alias("plan"))
    assert len(discover_categories(many, "plan")) == 3000


def test_plan_counts(golden_licenses):
    counts = {r.plan: r.n_licenses for r in t.plan_counts(golden_licenses).collect()}
    assert counts == {
        "pro": 3,
        "business": 1,
        "edu": 1,
        "basic1": 1,
        None: 1,
        "enterprise": 1,
        "academic": 1,
        "edu1": 1,
    }


def test_purchase_days_and_sequence(golden_licenses):
    assert rows_of(t.purchase_sequence(golden_licenses, AS_OF)) == [
        (1, 184, 1, 1),
        (1, 366, 5, 2),
        (2, 206, 0, 1),
        (2, 306, 5, 2),
        (3, 245, 1, 1),
        (4, 721, 1, 1),
        (4, 731, 1, 2),
        (6, 366, 1, 1),
    ]


def test_repeat_buyers_and_gaps(golden_licenses):
    repeat = t.repeat_buyers(golden_licenses, AS_OF)
    assert {r.team_id for r in repeat.collect()} == {1, 2, 4}
    gaps = t.repurchase_gaps(golden_licenses, AS_OF)
    assert rows_of(gaps, "team_id", "cum_seq", "gap_days") == [
        (1, 1, 0),
        (1, 2, 182),
        (2, 1, 0),
        (2, 2, 100),
        (4, 1, 0),
        (4, 2, 10),
    ]


def test_average_repurchase(golden_licenses):
    assert rows_of(t.team_repurchase(golden_licenses, AS_OF)) == [
        (1, 182, 1, 182.0),
        (2, 100, 1, 100.0),
        (4, 10, 1, 10.0),
    ]
    assert t.avg_repurchase(golden_licenses, AS_OF).first()[0] == 141.0
    # Both bounds belong to the range.
    assert t.avg_repurchase(golden_licenses, AS_OF, 10, 100).first()[0] == 55.0
    assert t.avg_repurchase(golden_licenses, AS_OF, 11, 99).first()[0] is None


def test_license_features_and_targets(golden_licenses):
    assert rows_of(t.churn_targets(golden_licenses, AS_OF)) == [
        (1, 0, 1, 0, 0, 2, 460, 6, 184, 1, 0, 1),
        (2, 0, 0, 1, 0, 0, -59, 5, 206, -59, 0, 0),
        (3, 0, 0, 0, 0, 0, 214, 1, 245, 214, 1, 1),
        (4, 1, 0, 0, 1, 0, 1390, 2, 721, 690, 1, 1),
        (5, 0, 0, 0, 0, 1, 0, 4, None, None, 0, 0),
        (6, 0, 0, 0, 0, 0, 335, 1, 366, 335, 1, 1),
    ]


def test_paid_and_filled_activity(golden_activity, golden_licenses):
    assert t.paid_activity(golden_activity, golden_licenses).count() == 9
    filled = t.filled_activity(golden_activity)
    assert rows_of(
        filled.where("team_id = 1"), "user_id", "year", "month", "tasks_created"
    ) == [(0, 2020, 3, 2), (10, 0, 0, 4), (10, 2020, 2, 3), (11, 2020, 2, 0)]


def test_team_month_usage(golden_activity, golden_licenses):
    usage = t.team_month_usage(golden_activity, golden_licenses).where("team_id < 3")
    assert rows_of(
        usage, "team_id", "year", "month", "user_id", "tasks_created"
    ) == [(1, 0, 0, 1, 4), (1, 2020, 2, 2, 3), (1, 2020, 3, 1, 2), (2, 2020, 5, 1, 2)]


def test_activity_features(golden_activity, golden_licenses):
    features = t.activity_features(golden_activity, golden_licenses)
    names = ("team_id", "user_id_monthly", "tasks_created_monthly", "user_id",
             "tasks_created")
    assert rows_of(features, *names) == [
        (1, pytest.approx(4 / 3), 3.0, 3, 9),
        (2, 1.0, 2.0, 1, 2),
        (3, 1.0, 7.0, 1, 7),
        (4, 1.0, 2.0, 1, 2),
        (5, 1.0, 0.0, 1, 0),
    ]
    assert len(features.columns) == 23


def test_monthly_overall(golden_activity, golden_licenses):
    row = t.monthly_overall(golden_activity, golden_licenses).first()
    assert row.tasks_created_monthly == pytest.approx((3 + 2 + 7 + 2 + 0) / 5)
    assert row.user_id_monthly == pytest.approx((4 / 3 + 4) / 5)


def test_prediction_dataset(golden_licenses, golden_activity):
    dataset = t.prediction_dataset(golden_licenses, golden_activity, AS_OF)
    assert dataset.columns == list(DATASET) and len(dataset.columns) == 34
    assert len(FEATURES) == 28
    assert t.feature_matrix(dataset).columns == list(FEATURES)
    assert actual_dataset(dataset) == expected_dataset(
        GOLDEN_LICENSES, GOLDEN_ACTIVITY
    )


def test_dataset_options(golden_licenses, golden_activity):
    compat = t.prediction_dataset(
        golden_licenses, golden_activity, AS_OF, compat_names=True
    )
    assert compat.columns[28:32] == [
        "license_end_recency_x", "quantity", "license_start_recency",
        "license_end_recency_y",
    ]
    everyone = t.prediction_dataset(
        golden_licenses, golden_activity, AS_OF, keep="licenses"
    )
    assert rows_of(everyone, "team_id", "user_id")[-1] == (6, 0)
    with pytest.raises(ValueError, match="keep"):
        t.prediction_dataset(golden_licenses, golden_activity, AS_OF, keep="all")


@pytest.mark.parametrize(
    "rows",
    [
        # Nobody bought twice.
        [(1, 1, "2020-01-01", "2020-02-01", "pro1", 1)],
        # The only repurchase is out of range.
        [
            (1, 1, "2020-01-01", "2020-02-01", "pro1", 1),
            (2, 1, "2020-01-03", "2020-02-01", "pro1", 1),
        ],
        # Bought twice, but on the same day.
        [
            (1, 1, "2020-01-01", "2020-02-01", "edu3", 1),
            (2, 1, "2020-01-01", "2020-02-01", "edu3", 1),
        ],
    ],
)
def test_no_average_means_no_label(spark, rows):
    targets = t.churn_targets(licenses(spark, rows), AS_OF)
    assert expected_average(rows) is None
    assert t.avg_repurchase(licenses(spark, rows), AS_OF).first()[0] is None
    assert rows_of(targets, "Target1", "Target2", "plan_academic") == [(0, 0, 0)]


def test_empty_tables(spark):
    none = t.prediction_dataset(licenses(spark, []), activity(spark, []), AS_OF)
    assert none.columns == list(DATASET) and none.count() == 0


def test_recency_of_past_present_and_future(spark):
    rows = [
        (1, 1, "2020-12-31", "2021-01-01", "pro1", 1),
        (2, 2, "2021-01-02", None, "pro1", 1),
    ]
    recent = t.license_recency(licenses(spark, rows), datetime.date(2021, 1, 1))
    assert rows_of(recent, "license_start_recency", "license_end_recency") == [
        (-1, None),
        (1, 0),
    ]


def test_today_is_the_default(spark):
    row = (1, 1, "2020-01-01", None, "pro1", 1)
    recent = t.license_recency(licenses(spark, [row])).select(
        F.date_add("license_start", F.col("license_start_recency"))
        == F.current_date()
    )
    assert recent.first()[0]


@pytest.mark.parametrize("good", ["2019-1-5", "2019-01-05"])
def test_dates_with_and_without_zeros(spark, good):
    rows = [(1, 1, good, good, "pro1", 1)]
    recent = t.license_recency(licenses(spark, rows), AS_OF)
    assert recent.first().license_start == datetime.date(2019, 1, 5)


@pytest.mark.parametrize(
    "bad",
    ["2019-13-05", "2019-02-30", "2019-01-05 10:00:00", "19-1-5", "12019-1-5", "x"],
)
def test_bad_dates(spark, bad):
    rows = licenses(spark, [(1, 1, bad, "2020-01-01", "pro1", 1)])
    with pytest.raises(PySparkException):
        t.license_recency(rows, AS_OF).collect()
    assert t.license_recency(rows, AS_OF, lenient=True).first().license_start is None
    assert t.purchase_days(rows, AS_OF, lenient=True).count() == 0
    assert count_bad_dates(rows, "license_start", "license_end").first() == (1, 0)


def test_date_columns_need_no_parsing(spark, golden_licenses, golden_activity):
    typed = golden_licenses.withColumns(
        {
            "license_start": F.col("license_start").cast("date"),
            "license_end": F.col("license_end").cast("timestamp_ntz"),
        }
    )
    events = golden_activity.withColumn("event_date", F.to_date("event_date"))
    assert rows_of(t.prediction_dataset(typed, events, AS_OF)) == rows_of(
        t.prediction_dataset(golden_licenses, golden_activity, AS_OF)
    )


def test_two_digit_years(spark):
    df = spark.createDataFrame([("31-12-19",), (None,)], "d string")
    assert [r[0] for r in df.select(four_digit_year("d")).collect()] == [
        "31-12-2019",
        None,
    ]


def test_one_hot_of_an_absent_category_and_a_null(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "kind string, n int")
    assert rows_of(one_hot(df, "kind", ["a", "z"])) == [(1, 1, 0), (2, 0, 0)]
