"""License purchases: recency, plan families and one row of features per team."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tenuro.functions.categories import one_hot, plan_family
from tenuro.functions.dates import as_of_date, date_column, recency_days
from tenuro.functions.nulls import zero_if_null
from tenuro.schema import LICENSE_FEATURES, PLAN_CATEGORIES, PLAN_COLUMNS, TEAM


def team_licenses(licenses: DataFrame) -> DataFrame:
    """Purchases that name a team."""
    return licenses.where(F.col(TEAM).isNotNull())


def license_teams(licenses: DataFrame) -> DataFrame:
    """The paying teams, once each."""
    return team_licenses(licenses).select(TEAM).distinct()


def license_dates(licenses: DataFrame, as_of=None, lenient: bool = False) -> DataFrame:
    """Team purchases with their dates, and the days since each date."""
    today = as_of_date(as_of)
    dated = team_licenses(licenses).withColumns(
        {
            "license_end": date_column(licenses, "license_end", lenient),
            "license_start": date_column(licenses, "license_start", lenient),
        }
    )
    return dated.withColumns(
        {
            "license_end_recency": recency_days(F.col("license_end"), today),
            "license_start_recency": recency_days(F.col("license_start"), today),
        }
    )


def license_recency(
    licenses: DataFrame, as_of=None, lenient: bool = False
) -> DataFrame:
    """Team purchases with dates, days since each date, and plan families."""
    return plan_family(license_dates(licenses, as_of, lenient))


def prepare_licenses(
    licenses: DataFrame,
    as_of=None,
    categories: Sequence[str] = PLAN_CATEGORIES,
    lenient: bool = False,
) -> DataFrame:
    """One row per team purchase, with the plan as 0/1 columns placed last.

    ``categories`` lists the plans to encode; pass the result of
    ``discover_categories`` to encode every plan that occurs.
    """
    return one_hot(license_recency(licenses, as_of, lenient), "plan", categories)


def plan_counts(licenses: DataFrame) -> DataFrame:
    """Team purchases per plan family."""
    return (
        plan_family(team_licenses(licenses).select("plan"))
        .groupBy("plan")
        .agg(F.count(F.lit(1)).alias("n_licenses"))
    )


def license_features(
    licenses: DataFrame, as_of=None, lenient: bool = False
) -> DataFrame:
    """One row per team, in one aggregation.

    Purchases per plan family, sum and minimum of the days since license end,
    minimum of the days since license start, and licenses bought. A sum over
    nulls only is 0, a minimum over nulls only is null.
    """
    return (
        prepare_licenses(licenses, as_of, lenient=lenient)
        .groupBy(TEAM)
        .agg(
            *(F.sum(c).alias(c) for c in PLAN_COLUMNS),
            zero_if_null(F.sum("license_end_recency")).alias("license_end_recency_sum"),
            zero_if_null(F.sum("quantity")).alias("quantity"),
            F.min("license_start_recency").alias("license_start_recency"),
            F.min("license_end_recency").alias("license_end_recency_min"),
        )
        .select(*LICENSE_FEATURES)
    )
