"""Missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tenuro.functions.columns import column
from tenuro.schema import NULL_TOKENS


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Turn the usual spellings of "no value" into null in every text column."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *(
            F.when(~column(c).isin(*NULL_TOKENS), column(c)).alias(c)
            if c in text
            else column(c)
            for c in df.columns
        )
    )


def whole_number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as bigint.

    Columns with gaps are often written as ``12.0``, and gaps of floating-point
    columns arrive as NaN: the first reads as 12, the second as null. ``1e3`` reads
    as 1000. Anything that is not a whole number raises.
    """
    value, kind = column(name), df.schema[name].dataType
    fraction = F.raise_error(F.lit(f"{name} is not a whole number"))
    if isinstance(kind, T.StringType):
        plain = F.regexp_replace(value, r"\.0*\s*$", "")
        exact = value.cast("decimal(38,18)")
        whole = F.when(exact != F.floor(exact), fraction).otherwise(exact.cast("bigint"))
        scientific = value.rlike(r"^\s*[-+]?[0-9.]+[eE][-+]?[0-9]+\s*$")
        return F.when(scientific, whole).otherwise(plain.cast("bigint"))
    if isinstance(kind, T.FractionalType):
        if not isinstance(kind, T.DecimalType):
            value = F.when(~F.isnan(value), value)
        value = F.when(value != F.floor(value), fraction).otherwise(value)
    return value.cast("bigint")


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))
