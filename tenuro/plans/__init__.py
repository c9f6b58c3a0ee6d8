"""Whole pipelines: the dataset, the models trained on it, and their output."""

from tenuro.plans.dataset import feature_matrix, prediction_dataset
from tenuro.plans.modelling import (
    FULL_GRID,
    GridSearch,
    boosted_trees,
    build_pipeline,
    forest,
    grid_search,
    logistic,
    max_features,
    param_grid,
    staged_accuracy,
    train_forest,
    train_model,
    training_frame,
)
from tenuro.plans.scoring import (
    feature_importance,
    predict_classes,
    rank_features,
    score,
)
from tenuro.plans.trees import node_importance, node_table, score_in_batches

__all__ = [
    "FULL_GRID",
    "GridSearch",
    "boosted_trees",
    "build_pipeline",
    "feature_importance",
    "feature_matrix",
    "forest",
    "grid_search",
    "logistic",
    "max_features",
    "node_importance",
    "node_table",
    "param_grid",
    "predict_classes",
    "prediction_dataset",
    "rank_features",
    "score",
    "score_in_batches",
    "staged_accuracy",
    "train_forest",
    "train_model",
    "training_frame",
]
