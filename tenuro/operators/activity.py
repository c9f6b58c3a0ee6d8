"""Product usage: monthly averages and totals per paying team.

Usage of teams without a license does not count. Where Catalyst's size estimate
allows a broadcast of the team list, the filter runs at the scan. Where the list is
too large for that, ``paid_first`` decides. By default a bitmap of fixed size, marked at
a hash of every paying team, is sent to all tasks and drops most other usage at the scan;
what passes is shuffled once for an exact semi join, a busy team spread over several
tasks. With ``paid_first=False`` the join meets rows that are already aggregated, which
saves that shuffle but takes the usage of all teams through the aggregation; that pays
where nearly all teams have licenses. ``paid_first="bitmap"`` has the bitmap at the scan and
the exact join on aggregated rows: no shuffle of raw rows, and few others in the
aggregation. Results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tenuro.functions.columns import quoted
from tenuro.functions.dates import date_column
from tenuro.operators.licenses import license_teams, team_licenses
from tenuro.schema import MEASURES, MONTHLY, TEAM, TOTALS, USER

MONTH_KEYS = (TEAM, "year", "month")
#: Tasks that share the raw rows of one team in a shuffled semi join. The team list is
#: shuffled so many times over.
SALTS = 16
#: The bitmap of paying teams has 2**FILTER_BITS bits, as 64 in a row of 16 bytes: 4 MB. It
#: is of use up to some ten million teams; beyond that it lets more and more rows pass.
FILTER_BITS = 24


def paid_only(rows: DataFrame, licenses: DataFrame) -> DataFrame:
    """The aggregated rows whose team has bought a license."""
    return rows.join(license_teams(licenses), TEAM, "left_semi")


def paid_activity(activity: DataFrame, licenses: DataFrame) -> DataFrame:
    """Usage records of paying teams.

    These are raw rows, so a busy team can make a shuffled join uneven. Spark
    splits such a team over many tasks, but only where both sides are shuffled
    for the join itself. The team list is therefore made distinct under one
    more key, which leaves it in a distribution the join cannot take over.
    """
    teams = (
        team_licenses(licenses)
        .select(TEAM, F.hash(TEAM).alias("_spread"))
        .distinct()
        .select(TEAM)
    )
    return activity.join(teams, TEAM, "left_semi")


def filled_activity(activity: DataFrame, lenient: bool = False) -> DataFrame:
    """Usage that names a team, with year and month, and 0 for missing numbers.

    A missing user becomes user 0, and a missing date becomes month 0 of year
    0, which counts as one more month of activity.
    """
    date = date_column(activity, "event_date", lenient)
    rows = activity.where(F.col(TEAM).isNotNull()).withColumns(
        {"event_date": date, "year": F.year(date), "month": F.month(date)}
    )
    # The team is never missing here, and a bare column lets filters pass.
    return rows.fillna(0, [quoted(c) for c in rows.columns if c != TEAM])


def _is_broadcast(df: DataFrame) -> bool:
    """Whether Spark, by its estimate, broadcasts ``df`` in a join."""
    spark = df.sparkSession
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _bit(team_type: T.DataType, bits: int) -> Column:
    """The place of a team in the bitmap; both sides of a join must give one type."""
    return F.pmod(F.xxhash64(F.col(TEAM).cast(team_type)), F.lit(1 << bits))


def team_bitmap(
    teams: DataFrame, bits: int = FILTER_BITS, team_type: T.DataType = T.LongType()
) -> DataFrame:
    """(``word``, ``held``): 64 bits at a time, set at the hash of each team of ``teams``.

    2**(bits - 6) rows at most, made by partial aggregates.
    """
    bit = _bit(team_type, bits)
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("one")
    return (
        teams.select(bit.alias("bit"), F.shiftright(bit, 6).alias("word"))
        .select("word", one)
        .groupBy("word")
        .agg(F.bit_or("one").alias("held"))
    )


def maybe_paid(activity: DataFrame, teams: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Usage of ``teams`` and of some others, filtered without a shuffle of usage.

    The bitmap is broadcast; its size follows ``bits``, whatever the number of teams.
    """
    kinds = [df.schema[TEAM].dataType for df in (activity, teams)]
    whole = all(isinstance(k, T.IntegralType) for k in kinds)
    team_type = T.LongType() if whole else T.StringType()
    bit = _bit(team_type, bits)
    known = team_bitmap(teams, bits, team_type).toDF("_word", "_held")
    return (
        activity.withColumns({"_word": F.shiftright(bit, 6), "_bit": (bit % 64).cast("int")})
        .join(F.broadcast(known), "_word")
        .where(F.getbit("_held", F.col("_bit")) == 1)
        .select(*map(quoted, activity.columns))
    )


def _paid_to_aggregate(activity: DataFrame, licenses: DataFrame, salts: int) -> DataFrame:
    """:func:`paid_activity` for rows that are aggregated next.

    A shuffled join by team alone would leave the rows of a team in one task, and the
    aggregation would take over that distribution. So each team has ``salts`` places.
    """
    teams = license_teams(licenses)
    if _is_broadcast(teams):
        return activity.join(teams, TEAM, "left_semi")
    places = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_place")
    place = F.pmod(F.xxhash64(USER, "event_date"), F.lit(salts)).cast("int")
    rows = maybe_paid(activity, teams).withColumn("_place", place)
    return rows.join(teams.select(TEAM, places), [TEAM, "_place"], "left_semi").drop("_place")


def _counted(
    activity: DataFrame, licenses: DataFrame, lenient: bool, paid_first: bool | str, salts: int
):
    """Usage to aggregate, and what filters the aggregate."""
    if paid_first == "bitmap" and not _is_broadcast(teams := license_teams(licenses)):
        rows = filled_activity(maybe_paid(activity, teams), lenient)
        return rows, lambda rows: paid_only(rows, licenses)
    if paid_first:
        paid = _paid_to_aggregate(activity, licenses, salts)
        return filled_activity(paid, lenient), lambda rows: rows
    return filled_activity(activity, lenient), lambda rows: paid_only(rows, licenses)


def team_month_usage(
    activity: DataFrame,
    licenses: DataFrame,
    lenient: bool = False,
    paid_first: bool = True,
    salts: int = SALTS,
) -> DataFrame:
    """Distinct users and summed counters per team and month."""
    usage, paid = _counted(activity, licenses, lenient, paid_first, salts)
    return paid(usage.groupBy(*MONTH_KEYS).agg(*_users_and_sums()))


def team_monthly_average(
    activity: DataFrame,
    licenses: DataFrame,
    lenient: bool = False,
    paid_first: bool = True,
    salts: int = SALTS,
) -> DataFrame:
    """Mean of the monthly figures over the months a team was active in."""
    usage, paid = _counted(activity, licenses, lenient, paid_first, salts)
    monthly = usage.groupBy(*MONTH_KEYS).agg(*_users_and_sums())
    return paid(monthly.groupBy(TEAM).agg(*_monthly_means()))


def monthly_overall(
    activity: DataFrame,
    licenses: DataFrame,
    lenient: bool = False,
    paid_first: bool = True,
    salts: int = SALTS,
) -> DataFrame:
    """One row: the mean over all teams of their monthly averages."""
    return team_monthly_average(activity, licenses, lenient, paid_first, salts).agg(
        *(F.avg(c).alias(c) for c in MONTHLY)
    )


def team_totals(
    activity: DataFrame,
    licenses: DataFrame,
    lenient: bool = False,
    paid_first: bool = True,
    salts: int = SALTS,
) -> DataFrame:
    """Distinct users and summed counters per team, over all time."""
    usage, paid = _counted(activity, licenses, lenient, paid_first, salts)
    return paid(usage.groupBy(TEAM).agg(*_users_and_sums()))


def activity_features(
    activity: DataFrame,
    licenses: DataFrame,
    lenient: bool = False,
    paid_first: bool | str = True,
    salts: int = SALTS,
) -> DataFrame:
    """Monthly averages and totals, one row per paying team.

    One scan serves both. A usage record counts twice: with its numbers for its team, and
    with its user for their month. The first aggregation sums the numbers and keeps each
    user of a month once. Such a user counts for the month and as a sighting, the next
    aggregation merges the months and keeps each user once, and the last one counts both.
    So numbers move once, and rows of keys alone after that. Means need no numbers by month:
    months add up to the total. Every shuffle is keyed by more than the team or moves at
    most one row per team and task.
    """
    usage, paid = _counted(activity, licenses, lenient, paid_first, salts)
    types = {f.name: f.dataType for f in usage.schema}

    def struct(keys: tuple[str, ...], values: dict[str, Column], kinds: dict) -> Column:
        """One of ``keys`` and ``MEASURES``, missing where it isn't among ``values``."""
        return F.struct(
            *(values.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in (*keys, *MEASURES))
        )

    keys = ("year", "month", USER)
    presence = struct(keys, {c: F.col(c) for c in keys}, types)
    numbers = struct(keys, {m: F.col(m) for m in MEASURES}, types)
    by_user = (
        usage.select(TEAM, F.inline(F.array(presence, numbers)))
        .groupBy(*MONTH_KEYS, USER)
        .agg(*(F.sum(m).alias(m) for m in MEASURES))
    )
    # Numbers have no year, users of a month have no numbers.
    kinds = {f.name: f.dataType for f in by_user.schema}
    kinds |= {"seen": kinds[USER], "users": T.LongType()}
    keys = ("year", "month", "seen", "users")
    month = {"year": F.col("year"), "month": F.col("month"), "users": F.lit(1).cast("bigint")}
    user = F.array(
        struct(keys, month, kinds), struct(keys, {"seen": F.col(USER)}, kinds)
    )
    sums = F.array(struct(keys, {m: F.col(m) for m in MEASURES}, kinds))
    rows = (
        by_user.select(TEAM, F.inline(F.when(F.col("year").isNull(), sums).otherwise(user)))
        .groupBy(*MONTH_KEYS, "seen")
        .agg(*(F.sum(c).alias(c) for c in ("users", *MEASURES)))
        .groupBy(TEAM)
        .agg(
            F.count("year").alias("_months"),
            F.sum("users").alias("_users"),
            F.count("seen").alias(USER),
            *(F.sum(m).alias(m) for m in MEASURES),
        )
    )
    total = {USER: F.col("_users")}
    means = (
        (total.get(c, F.col(c)) / F.col("_months")).alias(f"{c}_monthly") for c in TOTALS
    )
    return paid(rows).select(TEAM, *means, *TOTALS)


def _users_and_sums():
    return F.count_distinct(USER).alias(USER), *(F.sum(m).alias(m) for m in MEASURES)


def _monthly_means():
    return (F.avg(c).alias(f"{c}_monthly") for c in TOTALS)
