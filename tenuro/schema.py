"""Table schemas, column groups and the fixed values that results depend on."""

from pyspark.sql import types as T

TEAM = "team_id"
USER = "user_id"

# The usage counters of the activity table.
MEASURES = (
    "projects_created",
    "tasks_created",
    "checklists_created",
    "agenda_events",
    "timeline_events",
    "reports_opened",
    "reports_saved",
    "invitations_sent",
    "invitations_claimed",
    "project_groups_created",
)

# Plan spellings and the family each one is counted under. A
# spelling that is not listed (edu1, basic1, ...) keeps its own name.
PLAN_FAMILIES = {
    "academic1": "academic",
    "academic12": "academic",
    "business1": "business",
    "business3": "business",
    "business6": "business",
    "business12": "business",
    "business18": "business",
    "business24": "business",
    "business36": "business",
    "edu3": "edu",
    "edu6": "edu",
    "edu12": "edu",
    "edu24": "edu",
    "edu36": "edu",
    "edu60": "edu",
    "enterprise12": "enterprise",
    "enterprise36": "enterprise",
    "pro1": "pro",
    "pro3": "pro",
    "pro6": "pro",
    "pro12": "pro",
    "pro18": "pro",
    "pro24": "pro",
    "pro36": "pro",
}
PLAN_CATEGORIES = ("academic", "business", "edu", "enterprise", "pro")

# The spellings of "no value" in a delimited text file.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

LICENSES = T.StructType(
    [
        T.StructField(TEAM, T.LongType()),
        T.StructField("license_start", T.StringType()),
        T.StructField("license_end", T.StringType()),
        T.StructField("plan", T.StringType()),
        T.StructField("quantity", T.LongType()),
    ]
)
ACTIVITY = T.StructType(
    [
        T.StructField(TEAM, T.LongType()),
        T.StructField(USER, T.LongType()),
        T.StructField("event_date", T.StringType()),
        *(T.StructField(m, T.LongType()) for m in MEASURES),
    ]
)

TOTALS = (USER, *MEASURES)
MONTHLY = tuple(f"{c}_monthly" for c in TOTALS)
PLAN_COLUMNS = tuple(f"plan_{c}" for c in PLAN_CATEGORIES)
LABELS = ("Target1", "Target2")

LICENSE_FEATURES = (
    TEAM,
    *PLAN_COLUMNS,
    "license_end_recency_sum",
    "quantity",
    "license_start_recency",
    "license_end_recency_min",
)
DATASET = (TEAM, *MONTHLY, *TOTALS, *LICENSE_FEATURES[1:], *LABELS)
# Recency decides the labels, so no recency column is a feature.
FEATURES = (*MONTHLY, *TOTALS, *PLAN_COLUMNS, "quantity")

COMPAT_NAMES = {
    "license_end_recency_sum": "license_end_recency_x",
    "license_end_recency_min": "license_end_recency_y",
}
