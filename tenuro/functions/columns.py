"""Column references that hold for any column name."""

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> str:
    """``name`` as one identifier, also where it contains a dot."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    return [column(c) for c in df.columns if c not in without]
