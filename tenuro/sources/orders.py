"""Licenses and activity derived from an order-entry schema.

Every order becomes one license purchase of the customer's team, and every line
item one usage record. The remainders below spread missing values, plans and
quantities evenly over the rows; no row is left out. Customers ending in 9 buy
under a team of their own that is never active, so that both kinds of unmatched
team occur: active without a license, and licensed without activity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenuro.schema import PLAN_FAMILIES

AS_OF = "2002-01-01"

#: The plan of an order, by the remainder of its key: known ones, then two unknown.
PLANS = (*PLAN_FAMILIES, "basic1", "edu1")


def licenses_from_orders(orders: DataFrame) -> DataFrame:
    """One license purchase per order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (30 * (1 + key % 12)).cast("int"))
    team = F.when(customer % 10 == 9, -customer).otherwise(customer)
    plan = F.element_at(
        F.array(*map(F.lit, PLANS)), (key % len(PLANS) + 1).cast("int")
    )
    return orders.select(
        key.alias("license_id"),
        _except(key % 101 == 0, team).alias("team_id"),
        _except(key % 211 == 0, start.cast("string")).alias("license_start"),
        _except((key % 211 == 0) | (key % 199 == 0), end.cast("string")).alias(
            "license_end"
        ),
        _except(key % 89 == 0, plan).alias("plan"),
        _except(key % 97 == 0, key % 5 + 1).alias("quantity"),
    )


def activity_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One usage record per line item."""
    rows = lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    order, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    quantity = F.col("l_quantity").cast("bigint")
    return rows.select(
        _except(order % 103 == 0, F.col("o_custkey")).alias("team_id"),
        _except((order + line) % 53 == 0, supplier).alias("user_id"),
        _except(
            (order + line) % 71 == 0, F.col("l_shipdate").cast("date").cast("string")
        ).alias("event_date"),
        _except(part % 7 == 0, quantity % 4).alias("projects_created"),
        _except(part % 11 == 0, quantity).alias("tasks_created"),
        _except(part % 13 == 0, line).alias("checklists_created"),
        (part % 5).alias("agenda_events"),
        (supplier % 3).alias("timeline_events"),
        (quantity % 6).alias("reports_opened"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("reports_saved"),
        ((part + line) % 4).alias("invitations_sent"),
        ((part + line) % 2).alias("invitations_claimed"),
        F.when(line == 1, line).alias("project_groups_created"),
    )


def _except(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)
