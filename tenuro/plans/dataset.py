"""The dataset that models are trained on and customers are scored from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tenuro.operators.activity import activity_features
from tenuro.operators.targets import churn_targets
from tenuro.schema import COMPAT_NAMES, DATASET, FEATURES, MONTHLY, TEAM, TOTALS


def prediction_dataset(
    licenses: DataFrame,
    activity: DataFrame,
    as_of=None,
    low: float = 30,
    high: float = 365,
    keep: str = "activity",
    compat_names: bool = False,
    lenient: bool = False,
) -> DataFrame:
    """Usage, license features and labels, one row per team.

    Teams need both a license and activity. With ``keep="licenses"`` licensed
    teams without activity are kept, with all usage figures 0. Both sides have
    one row per team by then, so no team can make the join uneven.
    """
    usage = activity_features(activity, licenses, lenient, paid_first="bitmap")
    targets = churn_targets(licenses, as_of, low, high, lenient)
    if keep == "activity":
        rows = usage.join(targets, TEAM, "left")
    elif keep == "licenses":
        rows = targets.join(usage, TEAM, "left").fillna(0, [*MONTHLY, *TOTALS])
    else:
        raise ValueError(f"keep must be 'activity' or 'licenses', not {keep!r}")
    rows = rows.select(*DATASET)
    return rows.withColumnsRenamed(COMPAT_NAMES) if compat_names else rows


def feature_matrix(dataset: DataFrame) -> DataFrame:
    """The columns a model may see: no key, no recency and no label."""
    return dataset.select(*FEATURES)
