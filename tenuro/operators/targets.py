"""The two attrition labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenuro.operators.licenses import license_features
from tenuro.operators.repurchase import avg_repurchase


def with_targets(features: DataFrame, average: DataFrame | float) -> DataFrame:
    """Add ``Target1`` and ``Target2`` to one row of license features per team.

    Target1: the last license ended longer ago than the average repurchase
    time. Target2: the last purchase is longer ago than that and the last
    license has ended. A comparison with null gives 0.
    """
    limit = average.scalar() if isinstance(average, DataFrame) else F.lit(average)
    ended = F.col("license_end_recency_min")
    bought = F.col("license_start_recency")
    return features.withColumns(
        {"Target1": _flag(ended > limit), "Target2": _flag((bought > limit) & (ended > 0))}
    )


def churn_targets(
    licenses: DataFrame,
    as_of=None,
    low: float = 30,
    high: float = 365,
    lenient: bool = False,
) -> DataFrame:
    """License features and labels, one row per team.

    The average is a scalar subquery: it runs once, on two columns, and its one
    value is sent to the tasks that compare with it.
    """
    return with_targets(
        license_features(licenses, as_of, lenient),
        avg_repurchase(licenses, as_of, low, high, lenient),
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)
