"""Column expressions shared by the operators."""

from tenuro.functions.categories import (
    category_counts,
    discover_categories,
    one_hot,
    plan_family,
)
from tenuro.functions.dates import (
    as_of_date,
    count_bad_dates,
    date_column,
    four_digit_year,
    recency_days,
    watch_dates,
)
from tenuro.functions.hashing import HASH_RANGE, key_hash
from tenuro.functions.lineage import (
    clear_scratch,
    discard,
    kept,
    materialise,
    release,
    scratch_path,
    shared_folder,
    written,
)
from tenuro.functions.nulls import null_tokens_to_null, whole_number, zero_if_null

__all__ = [
    "HASH_RANGE",
    "as_of_date",
    "category_counts",
    "clear_scratch",
    "count_bad_dates",
    "date_column",
    "discard",
    "discover_categories",
    "four_digit_year",
    "kept",
    "key_hash",
    "materialise",
    "null_tokens_to_null",
    "one_hot",
    "plan_family",
    "recency_days",
    "release",
    "scratch_path",
    "shared_folder",
    "watch_dates",
    "whole_number",
    "written",
    "zero_if_null",
]
