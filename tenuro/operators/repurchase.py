"""How long teams take to buy again.

Purchases are first collapsed to one row per team and purchase day. After that
a team has at most one row per calendar day, however many licenses it bought,
so the windows over a team below stay small even for the busiest team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tenuro.functions.nulls import zero_if_null
from tenuro.operators.licenses import license_dates
from tenuro.schema import TEAM

RECENCY = "license_start_recency"


def purchase_days(
    licenses: DataFrame, as_of=None, lenient: bool = False
) -> DataFrame:
    """One row per team and purchase day, with the licenses bought that day."""
    # Asked of the text rather than of the date, the filter reaches the scan
    # and no date is parsed twice.
    rows = license_dates(
        licenses.where(F.col("license_start").isNotNull()), as_of, lenient
    )
    if lenient:
        rows = rows.where(F.col(RECENCY).isNotNull())
    return rows.groupBy(TEAM, RECENCY).agg(
        zero_if_null(F.sum("quantity")).alias("quantity")
    )


def purchase_sequence(
    licenses: DataFrame, as_of=None, lenient: bool = False
) -> DataFrame:
    """Purchase days numbered per team; 1 is the latest."""
    latest_first = W.partitionBy(TEAM).orderBy(RECENCY)
    return purchase_days(licenses, as_of, lenient).withColumn(
        "cum_seq", F.row_number().over(latest_first)
    )


def repeat_buyers(
    licenses: DataFrame, as_of=None, lenient: bool = False
) -> DataFrame:
    """The numbered purchase days of teams that have at least two of them."""
    n_days = F.count(F.lit(1)).over(W.partitionBy(TEAM))
    return (
        purchase_sequence(licenses, as_of, lenient)
        .withColumn("n_days", n_days)
        .where(F.col("n_days") >= 2)
        .drop("n_days")
    )


def repurchase_gaps(
    licenses: DataFrame, as_of=None, lenient: bool = False
) -> DataFrame:
    """Days between each purchase day and the next later one; 0 for the latest."""
    latest_first = W.partitionBy(TEAM).orderBy(RECENCY)
    return repeat_buyers(licenses, as_of, lenient).withColumn(
        "gap_days", zero_if_null(F.col(RECENCY) - F.lag(RECENCY).over(latest_first))
    )


def team_repurchase(
    licenses: DataFrame, as_of=None, lenient: bool = False
) -> DataFrame:
    """Average days between purchases, per team with at least two purchase days.

    The gaps of a team add up to the days between its first and last purchase,
    so an aggregation gives them without ordering the purchases.
    """
    return (
        purchase_days(licenses, as_of, lenient)
        .groupBy(TEAM)
        .agg(
            (F.max(RECENCY) - F.min(RECENCY)).alias("total_gap_days"),
            (F.count(F.lit(1)) - 1).alias("repurchases"),
        )
        .where(F.col("repurchases") >= 1)
        .withColumn(
            "avg_repurchase_days", F.col("total_gap_days") / F.col("repurchases")
        )
    )


def avg_repurchase(
    licenses: DataFrame,
    as_of=None,
    low: float = 30,
    high: float = 365,
    lenient: bool = False,
) -> DataFrame:
    """One row: the mean repurchase time of the teams within ``low..high`` days.

    Both bounds are inclusive. Without any such team the value is null.
    """
    return (
        team_repurchase(licenses, as_of, lenient)
        .where(F.col("avg_repurchase_days").between(low, high))
        .agg(F.avg("avg_repurchase_days").alias("avg_repurchase_days"))
    )
