"""Small input tables, and the pipeline once more in plain Python."""

from __future__ import annotations

import datetime
from collections import defaultdict
from statistics import fmean

from pyspark.sql import types as T

from tenuro.schema import ACTIVITY, LICENSES, MEASURES, PLAN_CATEGORIES, PLAN_FAMILIES

AS_OF = "2021-01-01"

# license_id, team, start, end, plan, quantity
GOLDEN_LICENSES = [
    (1, 1, "2020-01-01", "2020-07-01", "pro1", 2),
    (2, 1, "2020-01-01", "2020-04-01", "business12", 3),
    (3, 1, "2020-07-01", "2020-12-31", "pro12", 1),
    (4, 2, "2020-03-01", "2021-03-01", "edu12", 5),
    (5, 2, "2020-06-09", None, "basic1", None),
    (6, 3, "2020-05-01", "2020-06-01", None, 1),
    (7, None, "2020-05-01", "2020-06-01", "pro1", 9),
    (8, 4, "2019-01-01", "2019-02-01", "enterprise12", 1),
    (9, 4, "2019-01-11", "2019-02-11", "academic1", 1),
    (10, 5, None, None, "pro3", 4),
    (11, 6, "2020-01-01", "2020-02-01", "edu1", 1),
]

# team, user, date, tasks
GOLDEN_ACTIVITY = [
    (1, 10, "2020-02-01", 3),
    (1, 11, "2020-02-15", None),
    (1, None, "2020-03-01", 2),
    (1, 10, None, 4),
    (2, 0, "2020-05-05", 1),
    (2, None, "2020-05-06", 1),
    (3, 5, "2020-05-05", 7),
    (9, 7, "2020-05-05", 100),
    (None, 7, "2020-05-05", 100),
    (4, 8, "2019-01-05", 2),
    (5, 9, "2020-12-01", None),
]

LICENSE_ROW = T.StructType([T.StructField("license_id", T.LongType()), *LICENSES])


def licenses(spark, rows):
    return spark.createDataFrame(rows, LICENSE_ROW)


def activity(spark, rows):
    """``rows`` give team, user, date and tasks; the other counters are 0."""
    at = MEASURES.index("tasks_created")
    wide = [
        (team, user, date, *(tasks if i == at else 0 for i in range(len(MEASURES))))
        for team, user, date, tasks in rows
    ]
    return spark.createDataFrame(wide, ACTIVITY)


def rows_of(df, *names):
    """Rows as tuples, in key order."""
    rows = df.select(*names).collect() if names else df.collect()
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


def days_since(text):
    if text is None:
        return None
    as_of = datetime.date.fromisoformat(AS_OF)
    return (as_of - datetime.date.fromisoformat(text)).days


def expected_average(license_rows, low=30, high=365):
    """Mean repurchase time, by walking each team's purchase days in order."""
    days = defaultdict(set)
    for _, team, start, *_ in license_rows:
        if team is not None and start is not None:
            days[team].add(days_since(start))
    means = []
    for recencies in days.values():
        ordered = sorted(recencies)
        gaps = [later - sooner for sooner, later in zip(ordered, ordered[1:])]
        if gaps and low <= fmean(gaps) <= high:
            means.append(fmean(gaps))
    return fmean(means) if means else None


def expected_dataset(license_rows, activity_rows):
    """team -> (users monthly, tasks monthly, users, tasks, plan counts, quantity,
    sum of end recency, first label, second label)."""
    average = expected_average(license_rows)
    bought = defaultdict(list)
    for _, team, start, end, plan, quantity in license_rows:
        if team is not None:
            bought[team].append((days_since(start), days_since(end), plan, quantity))
    used = defaultdict(list)
    for team, user, date, tasks in activity_rows:
        if team in bought:
            used[team].append((user or 0, date[:7] if date else "none", tasks or 0))
    result = {}
    for team, usage in used.items():
        users, tasks = defaultdict(set), defaultdict(int)
        for user, month, n in usage:
            users[month].add(user)
            tasks[month] += n
        rows = bought[team]
        families = [PLAN_FAMILIES.get(p, p) for _, _, p, _ in rows]
        start = min((s for s, *_ in rows if s is not None), default=None)
        end = min((e for _, e, *_ in rows if e is not None), default=None)
        late = average is not None and end is not None and end > average
        idle = average is not None and start is not None and start > average
        result[team] = (
            fmean(len(u) for u in users.values()),
            fmean(tasks.values()),
            len({user for user, *_ in usage}),
            sum(n for *_, n in usage),
            tuple(families.count(c) for c in PLAN_CATEGORIES),
            sum(q or 0 for *_, q in rows),
            sum(e or 0 for _, e, *_ in rows),
            int(late),
            int(idle and end is not None and end > 0),
        )
    return result


def actual_dataset(df):
    return {
        r.team_id: (
            r.user_id_monthly,
            r.tasks_created_monthly,
            r.user_id,
            r.tasks_created,
            tuple(r[f"plan_{c}"] for c in PLAN_CATEGORIES),
            r.quantity,
            r.license_end_recency_sum,
            r.Target1,
            r.Target2,
        )
        for r in df.collect()
    }
