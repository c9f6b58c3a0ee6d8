"""The queries of the library on the provided tables, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

import tenuro as t
from tenuro.functions import (
    category_counts,
    count_bad_dates,
    discover_categories,
    four_digit_year,
    materialise,
)
from tenuro.functions.lineage import scratch_path, written
from tenuro.schema import FEATURES, LABELS, MEASURES, MONTHLY, PLAN_CATEGORIES, TOTALS
from tenuro.sources.orders import AS_OF, PLANS

#: All depths and shares of features of the full search, with fewer trees. README says
#: what is left out.
SMALL_GRID = t.FULL_GRID | {"numTrees": (25, 50, 100)}
LOGISTIC_GRID = {
    "regParam": (0.0, 0.001, 0.01, 0.1),
    "elasticNetParam": (0.0, 0.5, 1.0),
    "maxIter": (50,),
}
BOOSTED_GRID = {"maxDepth": (2, 3, 5), "maxIter": (5, 10, 20)}
FOREST = {"maxDepth": 10, "featureSubsetStrategy": t.max_features(0.9), "numTrees": 500}
#: One split on the plan columns, which SQL can find too.
STUMP = {"maxDepth": 1, "featureSubsetStrategy": "all", "numTrees": 1, "bootstrap": False}
#: The same with another split on each side, for which SQL can tell the splits, too.
TREE = STUMP | {"maxDepth": 2}
PLAN_FEATURES = tuple(f"plan_{c}" for c in PLAN_CATEGORIES)
#: Usage of many distinct values, most of them small.
USAGE_FEATURES = ("tasks_created", "user_id_monthly")
BINS = 32
#: More rows than any fold has, so that nothing is split.
NEVER = 1_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.licenses_from_orders(_table(spark, sf_dir, "orders"))


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.activity_from_orders(
        _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    )


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.prediction_dataset(
        _licenses(spark, sf_dir), _activity(spark, sf_dir), AS_OF
    )


def _round6(df: DataFrame, *names: str) -> DataFrame:
    """Means of doubles differ in the last digits with the order of addition."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _written_as_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.csv(path, header=True, nullValue="NA")
    return path


def _on_licenses(operator, *args, **options):
    return lambda spark, sf_dir: operator(_licenses(spark, sf_dir), *args, **options)


def _on_both(operator):
    return lambda spark, sf_dir: operator(
        _activity(spark, sf_dir), _licenses(spark, sf_dir)
    )


@lru_cache(maxsize=1)
def _model(spark: SparkSession, sf_dir: str):
    """The dataset with its split, and a forest trained on the training rows.

    Five queries use the same model; it is trained once for a session and folder.
    """
    dataset = materialise(t.with_split(_dataset(spark, sf_dir)))
    return dataset, t.train_forest(t.training_rows(dataset), FOREST)


def licenses_from_csv(spark, sf_dir):
    path = _written_as_csv(_licenses(spark, sf_dir), "licenses")
    return t.read_licenses(spark, path).withColumn(
        "license_id", F.col("license_id").cast("bigint")
    )


def activity_from_csv(spark, sf_dir):
    return t.read_activity(spark, _written_as_csv(_activity(spark, sf_dir), "activity"))


def legacy_dates(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    short = orders.select(
        "o_orderkey", F.date_format("o_orderdate", "dd-MM-yy").alias("short_date")
    )
    repaired = four_digit_year("short_date")
    return short.withColumns(
        {"repaired": repaired, "repaired_date": F.to_date(repaired, "dd-MM-yyyy")}
    )


def bad_dates(spark, sf_dir):
    licenses = _licenses(spark, sf_dir)
    # Dates with a two-digit year are text, but no dates.
    start = F.col("license_start").cast("date")
    short = licenses.withColumn("short_start", F.date_format(start, "dd-MM-yy"))
    return count_bad_dates(short, "license_start", "license_end", "short_start")


def plan_one_hot_discovered(spark, sf_dir):
    licenses = t.license_recency(_licenses(spark, sf_dir), AS_OF)
    plans = discover_categories(licenses, "plan")
    return t.prepare_licenses(_licenses(spark, sf_dir), AS_OF, categories=plans)


def plan_counts_by_team(spark, sf_dir):
    return category_counts(
        t.license_recency(_licenses(spark, sf_dir), AS_OF), "team_id", "plan"
    )


def licenses_from_reordered_csv(spark, sf_dir):
    """Two files whose columns are in different order, each read by its own header."""
    licenses = _licenses(spark, sf_dir)
    odd = F.col("license_id") % 2 == 1
    first = _written_as_csv(licenses.where(odd), "licenses")
    columns = reversed(licenses.columns)
    second = _written_as_csv(licenses.where(~odd).select(*columns), "licenses")
    both = t.read_licenses(spark, first).unionByName(t.read_licenses(spark, second))
    return both.withColumn("license_id", F.col("license_id").cast("bigint"))


def activity_filled(spark, sf_dir):
    filled = t.filled_activity(_activity(spark, sf_dir))
    return filled.drop("event_date")


def activity_monthly_overall(spark, sf_dir):
    overall = t.monthly_overall(_activity(spark, sf_dir), _licenses(spark, sf_dir))
    return _round6(overall, *MONTHLY)


def plan_onehot_by_team(spark, sf_dir):
    features = t.license_features(_licenses(spark, sf_dir), AS_OF)
    return features.select("team_id", *(f"plan_{c}" for c in PLAN_CATEGORIES))


def avg_repurchase(spark, sf_dir):
    average = t.avg_repurchase(_licenses(spark, sf_dir), AS_OF)
    return _round6(average, "avg_repurchase_days")


def prediction_dataset_all_licensed(spark, sf_dir):
    return t.prediction_dataset(
        _licenses(spark, sf_dir), _activity(spark, sf_dir), AS_OF, keep="licenses"
    )


def prediction_dataset_compat(spark, sf_dir):
    return t.prediction_dataset(
        _licenses(spark, sf_dir), _activity(spark, sf_dir), AS_OF, compat_names=True
    )


def train_test_split(spark, sf_dir):
    return t.with_split(_dataset(spark, sf_dir)).select("team_id", "is_train")


def train_test_split_exact(spark, sf_dir):
    teams = materialise(_dataset(spark, sf_dir).select("team_id"))
    return t.exact_split(teams)


def cv_folds(spark, sf_dir):
    return t.with_folds(_dataset(spark, sf_dir)).select("team_id", "fold")


def cv_folds_stratified(spark, sf_dir):
    teams = materialise(_dataset(spark, sf_dir).select("team_id", "Target1"))
    return t.stratified_folds(teams)


def confusion_matrix(spark, sf_dir):
    return t.confusion_matrix(_dataset(spark, sf_dir), "Target1", "Target2")


def _report(swap_axes):
    def run(spark, sf_dir):
        report = t.classification_report(
            _dataset(spark, sf_dir), "Target1", "Target2", swap_axes=swap_axes
        )
        return _round6(report, "precision", "recall", "f1_score")

    return run


def _search(classifier=None, grid=SMALL_GRID, label_col="Target1"):
    def run(spark, sf_dir):
        train = t.training_rows(t.with_split(_dataset(spark, sf_dir)))
        return t.grid_search(
            train, grid, classifier=classifier and classifier(), label_col=label_col
        ).results

    return run


def feature_importance_ranked(spark, sf_dir):
    _, model = _model(spark, sf_dir)
    return t.rank_features(t.feature_importance(model))


def feature_importance_top8(spark, sf_dir):
    _, model = _model(spark, sf_dir)
    return t.rank_features(t.feature_importance(model), top=8)


def test_predictions(spark, sf_dir):
    dataset, model = _model(spark, sf_dir)
    return t.predict_classes(model, t.holdout_rows(dataset))


def test_report(spark, sf_dir):
    dataset, model = _model(spark, sf_dir)
    return t.classification_report(t.predict_classes(model, t.holdout_rows(dataset)))


def churn_probability(spark, sf_dir):
    dataset, model = _model(spark, sf_dir)
    return t.score(model, dataset)


def _split_dataset(spark, sf_dir, features):
    """What small models train on and score, computed once for both."""
    dataset = t.with_split(_dataset(spark, sf_dir))
    return written(dataset.select("team_id", *features, *LABELS, "is_train"), "dataset")


def _stump(label_col, use, params=STUMP, features=PLAN_FEATURES, **options):
    def run(spark, sf_dir):
        dataset = _split_dataset(spark, sf_dir, features)
        model = t.train_forest(
            t.training_rows(dataset), params, label_col, features=features, **options
        )
        return use(model, dataset, label_col)

    return run


def _batched_scores(model, dataset, label_col):
    shares = t.score_in_batches(model, dataset.select("team_id", *PLAN_FEATURES))
    return _round6(shares.select("team_id", "churn_probability"), "churn_probability")


def _node_importance(model, dataset, label_col):
    found = t.node_importance(t.node_table(model), PLAN_FEATURES)
    return _round6(t.rank_features(found), "importance")


def _tree_search(label_col):
    def run(spark, sf_dir):
        train = t.training_rows(t.with_split(_dataset(spark, sf_dir)))
        found = t.grid_search(
            train,
            {"maxDepth": (1, 2)},
            classifier=t.forest(**{k: v for k, v in STUMP.items() if k != "maxDepth"}),
            label_col=label_col,
            features=PLAN_FEATURES,
        )
        best = F.col("maxDepth") == found.best_params["maxDepth"]
        return _round6(found.results.withColumn("is_best", best), "mean_accuracy")

    return run


def boosted_rounds(spark, sf_dir):
    """Accuracy after each of two rounds of boosted stumps."""
    dataset = _split_dataset(spark, sf_dir, PLAN_FEATURES)
    model = t.train_model(
        t.training_rows(dataset),
        t.boosted_trees(maxIter=2, maxDepth=1, stepSize=0.8),
        features=PLAN_FEATURES,
    )
    return _round6(t.staged_accuracy(model, dataset), "accuracy")


def forest_node_importance(spark, sf_dir):
    """The importances of the large forest, from its table of nodes."""
    _, model = _model(spark, sf_dir)
    return t.rank_features(t.node_importance(t.node_table(model)))


def churn_probability_in_batches(spark, sf_dir):
    """What ``churn_probability`` gives, with a megabyte of trees at a time."""
    dataset, model = _model(spark, sf_dir)
    return t.score_in_batches(model, dataset, batch_bytes=1 << 20)


def _stump_scores(model, dataset, label_col):
    classes = t.predict_classes(model, dataset, label_col)
    shares = _round6(t.score(model, dataset), "churn_probability")
    return classes.join(shares.select("team_id", "churn_probability"), "team_id")


def _stump_importance(model, dataset, label_col):
    return t.rank_features(t.feature_importance(model, PLAN_FEATURES))


def _stump_report(model, dataset, label_col):
    predictions = t.predict_classes(model, t.holdout_rows(dataset), label_col)
    report = t.classification_report(predictions)
    return _round6(report, "precision", "recall", "f1_score")


def _stump_search(label_col):
    def run(spark, sf_dir):
        train = t.training_rows(t.with_split(_dataset(spark, sf_dir)))
        fixed = {k: v for k, v in STUMP.items()}
        found = t.grid_search(
            train,
            {"minInstancesPerNode": (1, NEVER)},
            classifier=t.forest(**fixed),
            label_col=label_col,
            features=PLAN_FEATURES,
        )
        best = F.col("minInstancesPerNode") == found.best_params["minInstancesPerNode"]
        return _round6(found.results.withColumn("is_best", best), "mean_accuracy")

    return run


def boosted_stump(spark, sf_dir):
    """One round of boosting with one split."""
    dataset = _split_dataset(spark, sf_dir, PLAN_FEATURES)
    model = t.train_model(
        t.training_rows(dataset),
        t.boosted_trees(maxIter=1, maxDepth=1),
        features=PLAN_FEATURES,
    )
    scored = t.score(model, dataset).select("team_id", "churn_probability")
    return _round6(scored, "churn_probability")


def logistic_share(spark, sf_dir):
    """On one 0/1 feature a logistic regression gives the shares of the two groups."""
    dataset = _split_dataset(spark, sf_dir, ("plan_pro",)).withColumn(
        "plan_pro", (F.col("plan_pro") > 0).cast("int")
    )
    model = t.train_model(
        t.training_rows(dataset), t.logistic(tol=1e-12), features=("plan_pro",)
    )
    scored = t.score(model, dataset).select("team_id", "churn_probability")
    return scored.withColumn("churn_probability", F.round("churn_probability", 4))


def correlation_ranked(spark, sf_dir, top=None):
    """Features by the size of their correlation with the label."""
    dataset = _dataset(spark, sf_dir)
    found = dataset.agg(*(F.corr(f, "Target1").alias(f) for f in FEATURES))
    size = F.round(F.coalesce(F.abs("r"), F.lit(0.0)), 6)
    long = found.unpivot([], list(FEATURES), "feature", "r")
    ranked = t.rank_features(long.select("feature", size.alias("importance")), top)
    return ranked.withColumn("importance", F.round("importance", 4))


def correlation_top8(spark, sf_dir):
    return correlation_ranked(spark, sf_dir, top=8)


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query at the smallest scale."""
    return _dataset(spark, "/root/testdata/sf0.001")


def _llm(part: str) -> dict:
    """What the subpackage ``llm`` registers; nothing where it has been taken out."""
    try:
        registry = importlib.import_module("tenuro.llm.registry")
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith(("tenuro.llm", "corpus_pipeline")):
            raise
        return {}
    return getattr(registry, part)()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return core_queries() | _llm("queries")


def oracle_sql() -> dict[str, str]:
    """SQL for the same rows, where SQL can express them."""
    return core_oracle_sql() | _llm("oracle_sql")


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that need no optional subpackage."""
    return {
        "licenses_from_csv": licenses_from_csv,
        "activity_from_csv": activity_from_csv,
        "legacy_dates": legacy_dates,
        "bad_dates": bad_dates,
        "licenses_prepared": _on_licenses(t.license_recency, AS_OF),
        "licenses_one_hot": _on_licenses(t.prepare_licenses, AS_OF),
        "plan_one_hot_discovered": plan_one_hot_discovered,
        "plan_counts_by_team": plan_counts_by_team,
        "licenses_from_reordered_csv": licenses_from_reordered_csv,
        "plan_bin_counts": _on_licenses(t.plan_counts),
        "plan_onehot_by_team": plan_onehot_by_team,
        "license_teams": _on_licenses(t.license_teams),
        "license_features": _on_licenses(t.license_features, AS_OF),
        "activity_paid": _on_both(t.paid_activity),
        "activity_filled": activity_filled,
        "activity_team_month": _on_both(t.team_month_usage),
        "activity_team_monthly_avg": _on_both(t.team_monthly_average),
        "activity_monthly_overall": activity_monthly_overall,
        "activity_team_total": _on_both(t.team_totals),
        "activity_features": _on_both(t.activity_features),
        "purchase_days": _on_licenses(t.purchase_days, AS_OF),
        "purchase_sequence": _on_licenses(t.purchase_sequence, AS_OF),
        "repeat_buyers": _on_licenses(t.repeat_buyers, AS_OF),
        "repurchase_gaps": _on_licenses(t.repurchase_gaps, AS_OF),
        "clv_team": _on_licenses(t.team_repurchase, AS_OF),
        "avg_repurchase": avg_repurchase,
        "churn_targets": _on_licenses(t.churn_targets, AS_OF),
        "prediction_dataset": _dataset,
        "prediction_dataset_compat": prediction_dataset_compat,
        "prediction_dataset_all_licensed": prediction_dataset_all_licensed,
        "feature_matrix": lambda s, d: t.feature_matrix(_dataset(s, d)),
        "train_test_split": train_test_split,
        "train_test_split_exact": train_test_split_exact,
        "cv_folds": cv_folds,
        "cv_folds_stratified": cv_folds_stratified,
        "confusion_matrix": confusion_matrix,
        "classification_report": _report(swap_axes=False),
        "classification_report_swapped": _report(swap_axes=True),
        "stump_scores": _stump("Target1", _stump_scores),
        "stump_scores_target2": _stump("Target2", _stump_scores),
        "stump_importance": _stump("Target1", _stump_importance),
        "stump_report": _stump("Target1", _stump_report),
        "stump_search": _stump_search("Target1"),
        "stump_search_target2": _stump_search("Target2"),
        "tree_search": _tree_search("Target1"),
        "tree_search_target2": _tree_search("Target2"),
        "tree_scores_in_batches": _stump("Target1", _batched_scores, TREE),
        "tree_node_importance": _stump("Target1", _node_importance, TREE),
        "exact_stump_scores": _stump(
            "Target1", _stump_scores, STUMP, USAGE_FEATURES, exact_bins=BINS
        ),
        "boosted_stump": boosted_stump,
        "boosted_rounds": boosted_rounds,
        "logistic_share": logistic_share,
        "correlation_ranked": correlation_ranked,
        "correlation_top8": correlation_top8,
        "grid_search": _search(),
        "grid_search_target2": _search(label_col="Target2"),
        "grid_search_logistic": _search(t.logistic, LOGISTIC_GRID),
        "grid_search_boosted": _search(t.boosted_trees, BOOSTED_GRID),
        "feature_importance_ranked": feature_importance_ranked,
        "feature_importance_top8": feature_importance_top8,
        "test_predictions": test_predictions,
        "test_report": test_report,
        "churn_probability": churn_probability,
        "forest_node_importance": forest_node_importance,
        "churn_probability_in_batches": churn_probability_in_batches,
    }


# ---------------------------------------------------------------------------
# The same queries in SQL.

_LICENSES = f"""
licenses AS (
  SELECT o_orderkey AS license_id,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL
              WHEN o_custkey % 10 = 9 THEN -o_custkey ELSE o_custkey END AS team_id,
         CASE WHEN o_orderkey % 211 = 0 THEN NULL
              ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS license_start,
         CASE WHEN o_orderkey % 211 = 0 OR o_orderkey % 199 = 0 THEN NULL
              ELSE CAST(CAST(o_orderdate AS DATE)
                        + CAST(30 * (1 + o_orderkey % 12) AS INT) AS VARCHAR)
         END AS license_end,
         CASE WHEN o_orderkey % 89 = 0 THEN NULL
              ELSE split_part('{",".join(PLANS)}',
                              ',', CAST(o_orderkey % 26 + 1 AS INT)) END AS plan,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END AS quantity
  FROM orders)"""

_ACTIVITY = """
activity AS (
  SELECT CASE WHEN l_orderkey % 103 = 0 THEN NULL ELSE o_custkey END AS team_id,
         CASE WHEN (l_orderkey + l_linenumber) % 53 = 0 THEN NULL
              ELSE l_suppkey END AS user_id,
         CASE WHEN (l_orderkey + l_linenumber) % 71 = 0 THEN NULL
              ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS event_date,
         CASE WHEN l_partkey % 7 = 0 THEN NULL
              ELSE CAST(l_quantity AS BIGINT) % 4 END AS projects_created,
         CASE WHEN l_partkey % 11 = 0 THEN NULL
              ELSE CAST(l_quantity AS BIGINT) END AS tasks_created,
         CASE WHEN l_partkey % 13 = 0 THEN NULL
              ELSE CAST(l_linenumber AS BIGINT) END AS checklists_created,
         l_partkey % 5 AS agenda_events,
         l_suppkey % 3 AS timeline_events,
         CAST(l_quantity AS BIGINT) % 6 AS reports_opened,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS reports_saved,
         (l_partkey + l_linenumber) % 4 AS invitations_sent,
         (l_partkey + l_linenumber) % 2 AS invitations_claimed,
         CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE NULL END AS BIGINT)
           AS project_groups_created
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

_PREPARED = f"""
prepared AS (
  SELECT license_id, team_id, CAST(license_start AS DATE) AS license_start,
         CAST(license_end AS DATE) AS license_end,
         CASE WHEN plan IN ('pro1', 'pro3', 'pro6', 'pro12', 'pro18', 'pro24', 'pro36')
                THEN 'pro'
              WHEN plan IN ('business1', 'business3', 'business6', 'business12',
                            'business18', 'business24', 'business36') THEN 'business'
              WHEN plan IN ('edu3', 'edu6', 'edu12', 'edu24', 'edu36', 'edu60') THEN 'edu'
              WHEN plan IN ('academic1', 'academic12') THEN 'academic'
              WHEN plan IN ('enterprise12', 'enterprise36') THEN 'enterprise'
              ELSE plan END AS plan,
         quantity,
         CAST(date_diff('day', CAST(license_end AS DATE), DATE '{AS_OF}') AS INTEGER)
           AS license_end_recency,
         CAST(date_diff('day', CAST(license_start AS DATE), DATE '{AS_OF}') AS INTEGER)
           AS license_start_recency
  FROM licenses WHERE team_id IS NOT NULL)"""

_PURCHASES = """
days AS (
  SELECT team_id, license_start_recency,
         CAST(coalesce(sum(quantity), 0) AS BIGINT) AS quantity
  FROM prepared WHERE license_start_recency IS NOT NULL
  GROUP BY team_id, license_start_recency),
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY team_id
                                    ORDER BY license_start_recency) AS INTEGER) AS cum_seq
  FROM days),
repeaters AS (
  SELECT * FROM numbered
  WHERE team_id IN (SELECT team_id FROM numbered WHERE cum_seq = 2)),
gaps AS (
  SELECT *, CAST(coalesce(license_start_recency
                   - lag(license_start_recency) OVER (PARTITION BY team_id
                                                      ORDER BY license_start_recency), 0)
                 AS INTEGER) AS gap_days
  FROM repeaters),
clv AS (
  SELECT team_id, CAST(sum(gap_days) AS INTEGER) AS total_gap_days,
         CAST(max(cum_seq) - 1 AS BIGINT) AS repurchases,
         CAST(sum(gap_days) AS DOUBLE) / (max(cum_seq) - 1) AS avg_repurchase_days
  FROM gaps GROUP BY team_id),
average AS (
  SELECT avg(avg_repurchase_days) AS avg_repurchase_days
  FROM clv WHERE avg_repurchase_days BETWEEN 30 AND 365)"""

_LICENSE_FEATURES = (
    """
license_feat AS (
  SELECT team_id, """
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE plan = '{c}') AS BIGINT) AS plan_{c}"
        for c in PLAN_CATEGORIES
    )
    + """,
         CAST(coalesce(sum(license_end_recency), 0) AS BIGINT) AS license_end_recency_sum,
         CAST(coalesce(sum(quantity), 0) AS BIGINT) AS quantity,
         min(license_start_recency) AS license_start_recency,
         min(license_end_recency) AS license_end_recency_min
  FROM prepared GROUP BY team_id)"""
)

_TARGETS = """
targets AS (
  SELECT f.*,
         CASE WHEN license_end_recency_min > avg_repurchase_days THEN 1 ELSE 0 END
           AS "Target1",
         CASE WHEN license_start_recency > avg_repurchase_days
                   AND license_end_recency_min > 0 THEN 1 ELSE 0 END AS "Target2"
  FROM license_feat f, average)"""

_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)
_MEANS = ", ".join(f"avg({c}) AS {c}_monthly" for c in TOTALS)

_USAGE = f"""
paid AS (SELECT * FROM activity WHERE team_id IN (SELECT team_id FROM licenses)),
filled AS (
  SELECT team_id, coalesce(user_id, 0) AS user_id,
         CAST(coalesce(year(CAST(event_date AS DATE)), 0) AS INTEGER) AS year,
         CAST(coalesce(month(CAST(event_date AS DATE)), 0) AS INTEGER) AS month,
         {", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES)}
  FROM {{rows}}),
by_month AS (
  SELECT team_id, year, month, count(DISTINCT user_id) AS user_id, {_SUMS}
  FROM filled GROUP BY team_id, year, month),
monthly AS (SELECT team_id, {_MEANS} FROM by_month GROUP BY team_id),
total AS (
  SELECT team_id, count(DISTINCT user_id) AS user_id, {_SUMS}
  FROM filled GROUP BY team_id),
usage_feat AS (
  SELECT team_id, {", ".join(MONTHLY)}, {", ".join(TOTALS)}
  FROM monthly LEFT JOIN total USING (team_id))"""

_DATASET = """
dataset AS (SELECT * FROM usage_feat LEFT JOIN targets USING (team_id))"""


def _hash32(salt: str) -> str:
    key = f"md5('{salt}:' || CAST(team_id AS VARCHAR))"
    return f"CAST('0x' || substr({key}, 1, 8) AS BIGINT)"


def _report_sql(truth: str, guess: str, rows: str = "dataset") -> str:
    """Scores of both classes from their counts, then accuracy and averages."""
    counts = " UNION ALL ".join(
        f"""SELECT '{c}' AS class,
                   count(*) FILTER (WHERE {truth} = {c} AND {guess} = {c}) AS hits,
                   count(*) FILTER (WHERE {guess} = {c}) AS guessed,
                   count(*) FILTER (WHERE {truth} = {c}) AS support
            FROM {rows}"""
        for c in (0, 1)
    )
    names = ("precision", "recall", "f1_score")
    macro = ", ".join(f"avg({n}) AS {n}" for n in names)
    weighted = ", ".join(f"sum({n} * support) / sum(support) AS {n}" for n in names)
    return f"""
      , counts AS ({counts}),
      scores AS (
        SELECT class, hits, support,
               coalesce(CAST(hits AS DOUBLE) / nullif(guessed, 0), 0) AS precision,
               coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS recall,
               coalesce(2 * CAST(hits AS DOUBLE) / nullif(support + guessed, 0), 0)
                 AS f1_score
        FROM counts),
      report AS (
        SELECT class, {", ".join(names)}, support FROM scores
        UNION ALL
        SELECT 'accuracy', NULL, NULL, CAST(sum(hits) AS DOUBLE) / sum(support),
               sum(support) FROM scores
        UNION ALL
        SELECT 'macro avg', {macro}, sum(support) FROM scores
        UNION ALL
        SELECT 'weighted avg', {weighted}, sum(support) FROM scores)
      SELECT class, {", ".join(f"round({n}, 6) AS {n}" for n in names)},
             CAST(support AS BIGINT) AS support
      FROM report"""


_TRAIN = f"""
train AS (
  SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {_hash32("fold:0")}, team_id)
             - 1) % 3 AS fold
  FROM (SELECT *, "{{label}}" AS label FROM dataset
        WHERE {_hash32("split:0")} >= 1073741824))"""

# The best split of the training rows outside each fold; fold 3 is none of them.
_STUMPS = (
    "\nlong AS (\n"
    + "  UNION ALL\n".join(
        f"  SELECT k, {i} AS f, {c} AS v, label FROM train, folds WHERE fold <> k\n"
        for i, c in enumerate(PLAN_FEATURES)
    )
    + """),
cumulated AS (
  SELECT k, f, v, lead(v) OVER w AS following,
         sum(n) OVER w AS nl, sum(s) OVER w AS sl,
         sum(n) OVER (PARTITION BY k, f) AS na, sum(s) OVER (PARTITION BY k, f) AS sa
  FROM (SELECT k, f, v, count(*) AS n, sum(label) AS s FROM long GROUP BY k, f, v)
  WINDOW w AS (PARTITION BY k, f ORDER BY v)),
splits AS (
  SELECT k, f, v, sl / nl AS low, (sa - sl) / (na - nl) AS high, sa / na AS whole,
         row_number() OVER (PARTITION BY k ORDER BY
           round(sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl), 9) DESC, f, v) AS best
  FROM cumulated WHERE following IS NOT NULL),
stump AS (SELECT * FROM splits WHERE best = 1)"""
)
_FOLDS = "folds(k) AS (VALUES (0), (1), (2), (3))"


def _value(f: str) -> str:
    """The feature that column ``f`` has the number of."""
    cases = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(PLAN_FEATURES))
    return f"(CASE {f} {cases} END)"


_LEAF = f"CASE WHEN {_value('f')} <= v THEN low ELSE high END"

# The best split on each side of a stump, where there is one that gains anything.
_SECOND = (
    f"""
sided AS (
  SELECT stump.k, CAST({_value("stump.f")} > stump.v AS INTEGER) AS side, train.*
  FROM train JOIN stump ON fold <> stump.k),
side_values AS (
"""
    + "  UNION ALL\n".join(
        f"  SELECT k, side, {i} AS f, {c} AS v, label FROM sided\n"
        for i, c in enumerate(PLAN_FEATURES)
    )
    + f"""),
side_sums AS (
  SELECT k, side, f, v, lead(v) OVER w AS following,
         sum(n) OVER w AS nl, sum(s) OVER w AS sl,
         sum(n) OVER (PARTITION BY k, side, f) AS na,
         sum(s) OVER (PARTITION BY k, side, f) AS sa
  FROM (SELECT k, side, f, v, count(*) AS n, sum(label) AS s
        FROM side_values GROUP BY k, side, f, v)
  WINDOW w AS (PARTITION BY k, side, f ORDER BY v)),
side_splits AS (
  SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY round(gained, 9) DESC, f, v) AS best
  FROM (
    SELECT k, side, f, v, sl / nl AS low, (sa - sl) / (na - nl) AS high,
           sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na AS gained
    FROM side_sums WHERE following IS NOT NULL)),
tree AS (
  SELECT stump.k, stump.f, stump.v, sides.side, sides.whole AS whole2,
         s.f AS f2, s.v AS v2, s.low AS low2, s.high AS high2, s.gained AS gained2
  FROM stump
  JOIN (SELECT k, side, avg(label) AS whole FROM sided GROUP BY k, side) sides USING (k)
  LEFT JOIN side_splits s
    ON s.k = sides.k AND s.side = sides.side AND s.best = 1 AND s.gained > 1e-9)"""
)
_SIDE = f"side = CAST({_value('f')} > v AS INTEGER)"
_LEAF2 = f"""CASE WHEN f2 IS NULL THEN whole2
                  WHEN {_value("f2")} <= v2 THEN low2 ELSE high2 END"""

# The best split of two usage features at the borders of bins that hold equal numbers of
# rows, or one value each.
_BINNED = (
    "\nusage_values AS (\n"
    + "  UNION ALL\n".join(
        f"  SELECT {i} AS f, CAST({c} AS DOUBLE) AS v, label FROM train\n"
        for i, c in enumerate(USAGE_FEATURES)
    )
    + f"""),
counted AS (
  SELECT f, v, count(*) AS n, sum(label) AS s FROM usage_values GROUP BY f, v),
placed AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY f) <= {BINS}
                 THEN dense_rank() OVER (PARTITION BY f ORDER BY v)
                 ELSE floor({BINS} * (sum(n) OVER (PARTITION BY f ORDER BY v) - n)
                            / sum(n) OVER (PARTITION BY f)) END AS bin
  FROM counted),
bins AS (
  SELECT f, bin, min(v) AS least, max(v) AS most, sum(n) AS n, sum(s) AS s
  FROM placed GROUP BY f, bin),
bin_sums AS (
  SELECT f, bin, (most + lead(least) OVER w) / 2 AS place,
         sum(n) OVER w AS nl, sum(s) OVER w AS sl,
         sum(n) OVER (PARTITION BY f) AS na, sum(s) OVER (PARTITION BY f) AS sa
  FROM bins WINDOW w AS (PARTITION BY f ORDER BY bin)),
usage_stump AS (
  SELECT f, place, sl / nl AS low, (sa - sl) / (na - nl) AS high FROM bin_sums
  WHERE place IS NOT NULL
  ORDER BY round(sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl), 9) DESC, f, bin
  LIMIT 1)"""
)
_USAGE_LEAF = (
    "CASE WHEN (CASE f "
    + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(USAGE_FEATURES))
    + " END) < place THEN low ELSE high END"
)


def core_oracle_sql() -> dict[str, str]:
    """The core queries in SQL; models have no SQL form."""
    prepared = [_LICENSES, _PREPARED]
    purchases = [*prepared, _PURCHASES]
    targets = [*purchases, _LICENSE_FEATURES, _TARGETS]
    usage = [_LICENSES, _ACTIVITY, _USAGE.format(rows="paid")]
    dataset = [*targets, _ACTIVITY, _USAGE.format(rows="paid"), _DATASET]

    def sql(ctes: list[str], body: str) -> str:
        return f"WITH {','.join(ctes)}\n{body}"

    def stump(label: str, body: str) -> str:
        return sql([*dataset, _TRAIN.format(label=label), _FOLDS, _STUMPS], body)

    def scores(label: str) -> str:
        return stump(
            label,
            f"""SELECT team_id, "{label}" AS label, CAST({_LEAF} > 0.5 AS INTEGER)
                  AS prediction, round({_LEAF}, 6) AS churn_probability
                FROM dataset, stump WHERE k = 3""",
        )

    def search(label: str) -> str:
        return stump(
            label,
            f"""SELECT CAST(c AS BIGINT) AS combination,
                  CAST(CASE c WHEN 0 THEN 1 ELSE {NEVER} END AS BIGINT)
                    AS "minInstancesPerNode",
                  round(accuracy, 6) AS mean_accuracy,
                  row_number() OVER (ORDER BY accuracy DESC, c) = 1 AS is_best
                FROM (
                  SELECT c, avg(share) AS accuracy FROM (
                    SELECT c, fold,
                      avg(CAST(CAST((CASE c WHEN 0 THEN {_LEAF} ELSE whole END) > 0.5
                                    AS INTEGER) = label AS INTEGER)) AS share
                    FROM train JOIN stump ON fold = k, (VALUES (0), (1)) AS tried(c)
                    GROUP BY c, fold)
                  GROUP BY c)""",
        )

    def tree(label: str, body: str) -> str:
        ctes = [*dataset, _TRAIN.format(label=label), _FOLDS, _STUMPS, _SECOND]
        return sql(ctes, body)

    def depths(label: str) -> str:
        return tree(
            label,
            f"""SELECT CAST(depth - 1 AS BIGINT) AS combination,
                  CAST(depth AS BIGINT) AS "maxDepth",
                  round(accuracy, 6) AS mean_accuracy,
                  row_number() OVER (ORDER BY accuracy DESC, depth) = 1 AS is_best
                FROM (
                  SELECT depth, avg(share) AS accuracy FROM (
                    SELECT depth, fold, avg(CAST(CAST(answer > 0.5 AS INTEGER) = label
                                                 AS INTEGER)) AS share
                    FROM (
                      SELECT 1 AS depth, fold, label, {_LEAF} AS answer
                      FROM train JOIN stump ON fold = k
                      UNION ALL
                      SELECT 2, fold, label, {_LEAF2}
                      FROM train JOIN tree ON fold = k AND {_SIDE})
                    GROUP BY depth, fold)
                  GROUP BY depth)""",
        )

    # Importance by what splits gain, which is the decrease of impurity by the rows.
    tree_gains = ", ".join(f"({i}, '{c}')" for i, c in enumerate(PLAN_FEATURES))
    tree_importance = f"""
        , gains AS (
          SELECT f, gained FROM (
            SELECT f, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na AS gained,
                   row_number() OVER (ORDER BY
                     round(sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl), 9) DESC, f, v) AS best
            FROM cumulated WHERE k = 3 AND following IS NOT NULL)
          WHERE best = 1
          UNION ALL SELECT f2, gained2 FROM tree WHERE k = 3 AND f2 IS NOT NULL)
        SELECT feature, round(100 * coalesce(sum(gained), 0)
                              / (SELECT sum(gained) FROM gains), 6) AS importance
        FROM (VALUES {tree_gains}) AS names(f, feature) LEFT JOIN gains USING (f)
        GROUP BY feature"""

    # Two rounds: the second stump is fitted to what the first leaves, at step size 0.8.
    second_values = " UNION ALL ".join(
        f"SELECT {i} AS f, {c} AS v, r FROM residuals" for i, c in enumerate(PLAN_FEATURES)
    )
    rounds = f"""
        , residuals AS (
          SELECT train.*, 4 * (2 * train.label - 1)
                 / (1 + exp(2 * (2 * train.label - 1) * (2 * ({_LEAF}) - 1))) AS r
          FROM train, stump WHERE k = 3),
        round_values AS ({second_values}),
        round_sums AS (
          SELECT f, v, lead(v) OVER w AS following, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
                 sum(n) OVER (PARTITION BY f) AS na, sum(s) OVER (PARTITION BY f) AS sa
          FROM (SELECT f, v, count(*) AS n, sum(r) AS s FROM round_values GROUP BY f, v)
          WINDOW w AS (PARTITION BY f ORDER BY v)),
        round_stump AS (
          SELECT f AS f2, v AS v2, sl / nl AS low2, (sa - sl) / (na - nl) AS high2
          FROM round_sums WHERE following IS NOT NULL
          ORDER BY round(sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl), 9) DESC, f, v
          LIMIT 1),
        margins AS (
          SELECT "Target1" AS label, 2 * ({_LEAF}) - 1 AS one,
                 0.8 * (CASE WHEN {_value("f2")} <= v2 THEN low2 ELSE high2 END) AS two
          FROM dataset, stump, round_stump WHERE k = 3)
        SELECT CAST(1 AS INTEGER) AS rounds,
               round(avg(CAST(CAST(one > 0 AS INTEGER) = label AS INTEGER)), 6) AS accuracy
        FROM margins
        UNION ALL
        SELECT 2, round(avg(CAST(CAST(one + two > 0 AS INTEGER) = label AS INTEGER)), 6)
        FROM margins"""

    correlations = sql(
        dataset,
        "SELECT feature, round(100 * round(coalesce(abs(r), 0), 6), 4) AS importance FROM ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, CASE WHEN max({f}) > min({f}) "
            f'THEN corr({f}, "Target1") END AS r FROM dataset'
            for f in FEATURES
        )
        + ")",
    )
    importance = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN f = {i} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"
        " AS importance FROM stump WHERE k = 3"
        for i, c in enumerate(PLAN_FEATURES)
    )
    one_hot = "* EXCLUDE (plan), " + ", ".join(
        f"CASE WHEN plan = '{c}' THEN 1 ELSE 0 END AS plan_{c}" for c in PLAN_CATEGORIES
    )
    one_hot_all = one_hot + "".join(
        f", CASE WHEN plan = '{c}' THEN 1 ELSE 0 END AS plan_{c}"
        for c in ("basic1", "edu1")
    )
    usage_zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*MONTHLY, *TOTALS))
    bad = (
        "count(*) FILTER (WHERE {0} IS NOT NULL AND TRY_CAST({0} AS DATE) IS NULL) AS {0}"
    )
    return {
        "licenses_from_csv": sql([_LICENSES], "SELECT * FROM licenses"),
        "activity_from_csv": sql([_ACTIVITY], "SELECT * FROM activity"),
        "legacy_dates": """
            SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%y') AS short_date,
                   strftime(o_orderdate, '%d-%m-') || '20'
                     || strftime(o_orderdate, '%y') AS repaired,
                   CAST(strptime(strftime(o_orderdate, '%d-%m-') || '20'
                     || strftime(o_orderdate, '%y'), '%d-%m-%Y') AS DATE) AS repaired_date
            FROM orders""",
        "bad_dates": sql(
            [_LICENSES],
            "SELECT "
            + ", ".join(bad.format(c) for c in ("license_start", "license_end"))
            # None of the short dates has a year of four digits.
            + ", count(license_start) AS short_start FROM licenses",
        ),
        "licenses_prepared": sql(prepared, "SELECT * FROM prepared"),
        "licenses_one_hot": sql(prepared, f"SELECT {one_hot} FROM prepared"),
        "plan_one_hot_discovered": sql(
            prepared, f"SELECT {one_hot_all} FROM prepared"
        ),
        "plan_bin_counts": sql(
            prepared, "SELECT plan, count(*) AS n_licenses FROM prepared GROUP BY plan"
        ),
        "plan_onehot_by_team": sql(
            [*prepared, _LICENSE_FEATURES],
            "SELECT team_id, "
            + ", ".join(f"plan_{c}" for c in PLAN_CATEGORIES)
            + " FROM license_feat",
        ),
        "license_teams": sql(
            [_LICENSES],
            "SELECT DISTINCT team_id FROM licenses WHERE team_id IS NOT NULL",
        ),
        "license_features": sql(
            [*prepared, _LICENSE_FEATURES], "SELECT * FROM license_feat"
        ),
        "activity_paid": sql(
            [_LICENSES, _ACTIVITY, _USAGE.format(rows="paid")], "SELECT * FROM paid"
        ),
        "activity_filled": sql(
            [
                _LICENSES,
                _ACTIVITY,
                _USAGE.format(rows="activity WHERE team_id IS NOT NULL"),
            ],
            "SELECT * FROM filled",
        ),
        "activity_team_month": sql(usage, "SELECT * FROM by_month"),
        "activity_team_monthly_avg": sql(usage, "SELECT * FROM monthly"),
        "activity_monthly_overall": sql(
            usage,
            "SELECT "
            + ", ".join(f"round(avg({c}), 6) AS {c}" for c in MONTHLY)
            + " FROM monthly",
        ),
        "activity_team_total": sql(usage, "SELECT * FROM total"),
        "activity_features": sql(usage, "SELECT * FROM usage_feat"),
        "purchase_days": sql(purchases, "SELECT * FROM days"),
        "purchase_sequence": sql(purchases, "SELECT * FROM numbered"),
        "repeat_buyers": sql(purchases, "SELECT * FROM repeaters"),
        "repurchase_gaps": sql(purchases, "SELECT * FROM gaps"),
        "clv_team": sql(purchases, "SELECT * FROM clv"),
        "avg_repurchase": sql(
            purchases,
            "SELECT round(avg_repurchase_days, 6) AS avg_repurchase_days FROM average",
        ),
        "churn_targets": sql(targets, "SELECT * FROM targets"),
        "prediction_dataset": sql(dataset, "SELECT * FROM dataset"),
        "prediction_dataset_compat": sql(
            dataset,
            "SELECT * EXCLUDE (license_end_recency_sum, license_end_recency_min), "
            "license_end_recency_sum AS license_end_recency_x, "
            "license_end_recency_min AS license_end_recency_y FROM dataset",
        ),
        "prediction_dataset_all_licensed": sql(
            dataset,
            f"SELECT targets.*, {usage_zero} "
            "FROM targets LEFT JOIN usage_feat USING (team_id)",
        ),
        "feature_matrix": sql(dataset, f"SELECT {', '.join(FEATURES)} FROM dataset"),
        "train_test_split": sql(
            dataset,
            f"SELECT team_id, {_hash32('split:0')} >= 1073741824 AS is_train FROM dataset",
        ),
        "train_test_split_exact": sql(
            dataset,
            f"""SELECT team_id,
                  row_number() OVER (ORDER BY {_hash32("split:0")}, team_id)
                    > ceil(0.25 * count(*) OVER ()) AS is_train FROM dataset""",
        ),
        "cv_folds": sql(
            dataset,
            f"SELECT team_id, CAST({_hash32('fold:0')} % 3 AS INTEGER) AS fold FROM dataset",
        ),
        "cv_folds_stratified": sql(
            dataset,
            f"""SELECT team_id, "Target1", CAST((row_number() OVER (
                  PARTITION BY "Target1" ORDER BY {_hash32("fold:0")}, team_id) - 1) % 3
                  AS INTEGER) AS fold FROM dataset""",
        ),
        "plan_counts_by_team": sql(
            prepared,
            "SELECT team_id, plan, count(*) AS n FROM prepared "
            "WHERE plan IS NOT NULL GROUP BY team_id, plan",
        ),
        "licenses_from_reordered_csv": sql([_LICENSES], "SELECT * FROM licenses"),
        "stump_scores": scores("Target1"),
        "stump_scores_target2": scores("Target2"),
        "stump_importance": stump("Target1", importance),
        "stump_report": stump(
            "Target1",
            f""", guessed AS (
                  SELECT "Target1" AS label, CAST({_LEAF} > 0.5 AS INTEGER) AS prediction
                  FROM dataset, stump
                  WHERE k = 3 AND {_hash32("split:0")} < 1073741824)"""
            + _report_sql("label", "prediction", "guessed"),
        ),
        "stump_search": search("Target1"),
        "stump_search_target2": search("Target2"),
        "tree_search": depths("Target1"),
        "tree_search_target2": depths("Target2"),
        "tree_scores_in_batches": tree(
            "Target1",
            f"""SELECT team_id, round({_LEAF2}, 6) AS churn_probability
                FROM dataset JOIN tree ON k = 3 AND {_SIDE}""",
        ),
        "tree_node_importance": tree("Target1", tree_importance),
        "exact_stump_scores": sql(
            [*dataset, _TRAIN.format(label="Target1"), _BINNED],
            f"""SELECT team_id, "Target1" AS label, CAST({_USAGE_LEAF} > 0.5 AS INTEGER)
                  AS prediction, round({_USAGE_LEAF}, 6) AS churn_probability
                FROM dataset, usage_stump""",
        ),
        "boosted_rounds": stump("Target1", rounds),
        "boosted_stump": stump(
            "Target1",
            f"""SELECT team_id, round(1 / (1 + exp(-2 * (2 * ({_LEAF}) - 1))), 6)
                  AS churn_probability FROM dataset, stump WHERE k = 3""",
        ),
        "logistic_share": sql(
            [*dataset, _TRAIN.format(label="Target1")],
            """SELECT team_id, round(share, 4) AS churn_probability
               FROM dataset JOIN (SELECT plan_pro > 0 AS pro, avg(label) AS share
                                  FROM train GROUP BY plan_pro > 0)
                 ON pro = (plan_pro > 0)""",
        ),
        "correlation_ranked": correlations,
        "correlation_top8": f"{correlations} ORDER BY importance DESC, feature LIMIT 8",
        "confusion_matrix": sql(
            dataset,
            " UNION ALL ".join(
                f"""SELECT {c} AS label,
                      count(*) FILTER (WHERE "Target1" = {c} AND "Target2" = 0) AS predicted_0,
                      count(*) FILTER (WHERE "Target1" = {c} AND "Target2" = 1) AS predicted_1
                    FROM dataset"""
                for c in (0, 1)
            ),
        ),
        "classification_report": sql(dataset, _report_sql('"Target1"', '"Target2"')),
        "classification_report_swapped": sql(
            dataset, _report_sql('"Target2"', '"Target1"')
        ),
    }
