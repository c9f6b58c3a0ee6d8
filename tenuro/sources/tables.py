"""Reading licenses and activity from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from tenuro.functions.columns import column
from tenuro.functions.nulls import null_tokens_to_null, whole_number
from tenuro.schema import ACTIVITY, LICENSES


def read_licenses(
    spark: SparkSession, path: str, format: str = "csv", **options
) -> DataFrame:
    """License purchases; columns beyond the known ones are kept.

    CSV files must all have the header of the first, in its order. Records with more
    or fewer fields than the header raise; ``mode="PERMISSIVE"`` fills short ones with
    nulls (and cuts long ones). A line break inside a quoted field needs
    ``multiLine=True``, by which a file is no longer split over tasks; without it such
    a record raises like any other broken one.
    """
    return conform_licenses(_read(spark, path, format, options))


def read_activity(
    spark: SparkSession, path: str, format: str = "csv", **options
) -> DataFrame:
    """Product usage, one row per user and date; files as in :func:`read_licenses`."""
    return conform_activity(_read(spark, path, format, options))


def conform_licenses(df: DataFrame) -> DataFrame:
    """Give the license columns their declared types."""
    return _conform(df, LICENSES)


def conform_activity(df: DataFrame) -> DataFrame:
    """Give the activity columns their declared types."""
    return _conform(df, ACTIVITY)


def _read(spark: SparkSession, path: str, format: str, options: dict) -> DataFrame:
    if format != "csv":
        return spark.read.format(format).options(**options).load(path)
    # Everything is read as text: no pass over the data to guess types, files
    # stay splittable, and the spellings of null are handled before any cast.
    defaults = {
        "header": True,
        "sep": ",",
        "quote": '"',
        "escape": '"',
        "enforceSchema": False,  # check the header of every file
        "mode": "FAILFAST",
        "columnPruning": False,  # else fields nobody asks for aren't counted
    }
    return null_tokens_to_null(spark.read.options(**(defaults | options)).csv(path))


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    missing = [n for n in schema.names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(
        *(
            whole_number(df, c).alias(c)
            if c in schema.names and isinstance(schema[c].dataType, T.LongType)
            else column(c)
            for c in df.columns
        )
    )
