"""The relational operators, each a function from DataFrames to a DataFrame."""

from tenuro.operators.activity import (
    activity_features,
    filled_activity,
    monthly_overall,
    paid_activity,
    team_month_usage,
    team_monthly_average,
    team_totals,
)
from tenuro.operators.evaluation import classification_report, confusion_matrix
from tenuro.operators.licenses import (
    license_dates,
    license_features,
    license_recency,
    license_teams,
    plan_counts,
    prepare_licenses,
    team_licenses,
)
from tenuro.operators.repurchase import (
    avg_repurchase,
    purchase_days,
    purchase_sequence,
    repeat_buyers,
    repurchase_gaps,
    team_repurchase,
)
from tenuro.operators.split import (
    exact_split,
    holdout_rows,
    stratified_folds,
    training_rows,
    with_folds,
    with_split,
)
from tenuro.operators.targets import churn_targets, with_targets

__all__ = [
    "activity_features",
    "avg_repurchase",
    "churn_targets",
    "classification_report",
    "confusion_matrix",
    "exact_split",
    "filled_activity",
    "holdout_rows",
    "license_dates",
    "license_features",
    "license_recency",
    "license_teams",
    "monthly_overall",
    "paid_activity",
    "plan_counts",
    "prepare_licenses",
    "purchase_days",
    "purchase_sequence",
    "repeat_buyers",
    "repurchase_gaps",
    "stratified_folds",
    "team_licenses",
    "team_month_usage",
    "team_monthly_average",
    "team_repurchase",
    "team_totals",
    "training_rows",
    "with_folds",
    "with_split",
    "with_targets",
]
