"""Dates: strict parsing, recency in days, and checks for bad values."""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tenuro.functions.columns import column

# Four-digit year; month and day with or without a leading zero.
DATE_FORMAT = "yyyy-M-d"


def date_column(df: DataFrame, name: str, lenient: bool = False) -> Column:
    """Column ``name`` of ``df`` as a date.

    Text must read year-month-day: null stays null and anything else raises,
    or becomes null when ``lenient``. Date and timestamp columns are taken as
    they are, without their time of day.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name).cast("date")
    parse = F.try_to_date if lenient else F.to_date
    return parse(F.col(name), DATE_FORMAT)


def as_of_date(as_of: str | datetime.date | Column | None = None) -> Column:
    """The one "today" of a query; the current date when not given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("date")


def recency_days(date: Column, as_of: Column) -> Column:
    """Whole days from ``date`` to ``as_of``; negative when ``date`` is later."""
    return F.date_diff(as_of, date)


def four_digit_year(text: str | Column) -> Column:
    """Repair dates such as ``31-12-19``: the last part gets the century 20."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(
        F.substr(text, F.lit(1), F.lit(6)), F.lit("20"), F.substr(text, F.lit(7))
    )


def count_bad_dates(df: DataFrame, *names: str) -> DataFrame:
    """One row: for each named text column, how many values are not dates."""
    return df.agg(*_bad_dates(names))


def _bad_dates(names: tuple[str, ...]) -> list[Column]:
    return [
        F.count_if(
            column(n).isNotNull() & F.try_to_date(column(n), DATE_FORMAT).isNull()
        ).alias(n)
        for n in names
    ]


class WatchedDates(NamedTuple):
    """A frame whose bad dates are counted as it is read, and what has been counted."""

    rows: DataFrame
    seen: Observation

    def counts(self) -> dict[str, int]:
        """Bad values by column, of all rows. Waits for the first action on ``rows``."""
        return dict(self.seen.get)

    def check(self) -> None:
        """Raise if a value was no date, also one in a row that was dropped later on."""
        bad = {name: n for name, n in self.counts().items() if n}
        if bad:
            raise ValueError("not dates: " + ", ".join(f"{n} of {c}" for c, n in bad.items()))


def watch_dates(df: DataFrame, *names: str) -> WatchedDates:
    """``df`` with the bad values of its named text columns counted in the same pass.

    Catalyst drops rows and columns before it parses dates, so a query needn't meet every
    bad one. The counters stand before any filter: they see every row that is read, once,
    in the scan of the query itself. Filters aren't pushed down past them. They are filled
    by the first action on what is derived from ``rows``, provided that it reads all of it:
    a join with an empty side, or a limit, may not. An action that is run again, or a stage
    that lost its executor, may count rows twice; zero stays zero.
    """
    text = tuple(n for n in names if isinstance(df.schema[n].dataType, T.StringType))
    if not text:
        raise ValueError("none of the columns is text")
    seen = Observation()
    return WatchedDates(df.observe(seen, *_bad_dates(text)), seen)
