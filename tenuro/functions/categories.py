"""Plan families and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tenuro.functions.columns import columns
from tenuro.schema import PLAN_FAMILIES


def plan_family(df: DataFrame, column: str = "plan") -> DataFrame:
    """Replace every known plan spelling by its family; keep all others."""
    return df.replace(PLAN_FAMILIES, subset=[column])


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Replace ``column`` by one 0/1 column per category, placed last.

    A category that does not occur gives a column of zeros, and so does a null.
    """
    return df.select(
        *columns(df, without=(column,)),
        *(
            F.when(F.col(column) == c, 1).otherwise(0).alias(f"{column}_{c}")
            for c in categories
        ),
    )


def discover_categories(df: DataFrame, column: str) -> list[str]:
    """The distinct non-null values of ``column`` in order, for :func:`one_hot`.

    Each value becomes a column of a table, so all names reach the driver. For values
    too many to be columns use :func:`category_counts`, which needs no list.
    """
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().collect()
    return sorted(r[0] for r in rows)


def category_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """One-hot columns summed by ``key``, in long form: ``key``, ``column``, ``n``.

    One row for each pair that occurs, however many values there are. Nulls have no
    category and a null key is a key of its own.
    """
    present = df.where(F.col(column).isNotNull())
    return present.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
