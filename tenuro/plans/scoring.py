"""What a fitted model says: classes, probabilities and feature importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenuro.functions.columns import columns
from tenuro.plans.modelling import SHARE
from tenuro.schema import FEATURES, TEAM


def predict_classes(
    model: PipelineModel, df: DataFrame, label_col: str = "Target1"
) -> DataFrame:
    """Team, true class and predicted class."""
    return model.transform(df).select(
        TEAM,
        F.col(label_col).alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def score(
    model: PipelineModel, df: DataFrame, partitions: int | None = None
) -> DataFrame:
    """``df`` with the probability that the team leaves, ``churn_probability``.

    A large forest costs far more per row than the size of the row suggests, by
    which Spark sizes its tasks. ``partitions`` spreads the rows over more.
    """
    if partitions:
        df = df.repartition(partitions, TEAM)
    scored = model.transform(df)
    share = F.col(SHARE) if SHARE in scored.columns else vector_to_array("probability")[1]
    return scored.select(*columns(df), share.alias("churn_probability"))


def feature_importance(
    model: PipelineModel, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Share of each feature in the impurity decrease of the trees; sums to 1."""
    trees = next(s for s in model.stages if hasattr(s, "featureImportances"))
    importances = trees.featureImportances.toArray()
    return SparkSession.active().createDataFrame(
        [(f, float(i)) for f, i in zip(features, importances)],
        "feature string, importance double",
    )


def rank_features(importance: DataFrame, top: int | None = None) -> DataFrame:
    """Features by falling importance, in percent; the first ``top`` if given."""
    ranked = importance.select(
        "feature", (F.col("importance") * 100).alias("importance")
    ).orderBy(F.desc("importance"), "feature")
    return ranked if top is None else ranked.limit(top)
