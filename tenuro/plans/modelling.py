"""Training: feature assembly, cross-validated grid search and final models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Binarizer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from tenuro.functions.hashing import HASH_RANGE, key_hash
from tenuro.functions.lineage import kept, remove, scratch_path, written
from tenuro.operators.split import stratified_folds, with_folds
from tenuro.plans.bins import bin_stages
from tenuro.plans.forests import Binned, Forest, accuracies, binned, nodes_of, search_nodes
from tenuro.plans.trees import (
    assembled,
    ensemble,
    node_table,
    read_nodes,
    save_nodes,
    tree_sums,
)
from tenuro.schema import FEATURES, TEAM

LABEL = "label"
SHARE = "leave_share"
VALIDATION = "validation"
MAX_DEPTH = 30
#: Partitions of the training rows. Bootstrap samples are drawn by partition, so another
#: number gives another model; it doesn't follow any setting of the session.
PARTITIONS = 8
#: Parameters of which one fit of the largest value holds the models of all smaller ones.
NESTED = {Forest: ("maxDepth", "numTrees"), GBTClassifier: ("maxIter",)}


def max_features(fraction: float, n_features: int = len(FEATURES)) -> str:
    """Features tried per split for a share of them: rounded down, at least 1."""
    return str(max(1, int(fraction * n_features)))


# The full search, 90 combinations. The first parameter varies
# slowest, and of equally good combinations the first one wins.
FULL_GRID = {
    "maxDepth": (5, 10, 25),
    "featureSubsetStrategy": tuple(
        max_features(f) for f in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    ),
    "numTrees": (100, 500, 1000),
}


class GridSearch(NamedTuple):
    """Best parameters, every combination with its mean accuracy, and the best model.

    The model is fitted on all training rows, as :func:`train_model` would.
    """

    best_params: dict[str, Any]
    results: DataFrame
    best_model: PipelineModel


def forest(seed: int = 0, **params) -> Forest:
    """A random forest with bootstrap samples, of trees that keep all their leaves.

    It regresses on the 0/1 label. Variance is half the Gini impurity then, so splits are
    those of a classifier, and the mean of a leaf is its probability. Spark's classifier
    would merge neighbouring leaves of one class, and lose what tells them apart. (For
    ``minInfoGain``, note the half.) A threshold of 0.5 gives the class.

    The node each row has reached is cached, so that deep forests are not sent
    to the executors again for every level. ``maxMemoryInMB`` bounds the split
    statistics of a task: more of it means fewer passes over the rows.
    """
    options = {"cacheNodeIds": True, **_checked(params)}
    return Forest(
        labelCol=LABEL, predictionCol=SHARE, seed=seed, **options
    )


def boosted_trees(seed: int = 0, **params) -> GBTClassifier:
    return GBTClassifier(labelCol=LABEL, seed=seed, **_checked(params))


def logistic(**params) -> LogisticRegression:
    return LogisticRegression(labelCol=LABEL, **params)


def build_pipeline(
    classifier: Estimator, features: Sequence[str] = FEATURES
) -> Pipeline:
    """Feature assembly followed by ``classifier``; a null feature raises.

    After a regression a threshold gives ``prediction``.
    """
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="error"
    )
    stages = [assembler, classifier]
    if isinstance(classifier, Forest):
        stages.append(Binarizer(threshold=0.5, inputCol=SHARE, outputCol="prediction"))
    return Pipeline(stages=stages)


def training_frame(
    train: DataFrame,
    label_col: str = "Target1",
    seed: int = 0,
    folds: int | None = None,
    stratified: bool = True,
    features: Sequence[str] = FEATURES,
    partitions: int = PARTITIONS,
    max_training_rows: int | None = None,
) -> DataFrame:
    """Features and label of the training rows, computed once.

    Training reads its input many times, so the result is written rather than derived
    again from the source tables; it stays until ``clear_scratch``. Bootstrap samples
    are drawn by position, so rows are put in a fixed order first: the same rows, seed
    and ``partitions`` give the same model. With ``folds`` there is a ``fold`` column
    too: the one of ``train``, or else one that spreads each label evenly
    (``stratified``) or by the hash of the team alone.

    Forests are built on the driver and sent to the executors, and deep ones grow with
    the rows they are fitted on. ``max_training_rows`` fits on about that many, chosen by
    a hash of the team; ``minInstancesPerNode`` bounds trees as well.
    """
    return _training_frame(
        train, label_col, seed, folds, stratified, features, partitions,
        max_training_rows, keep=written,
    )


@contextmanager
def _training(*args, **options) -> Iterator[DataFrame]:
    """:func:`training_frame` for the length of a ``with`` block."""
    with ExitStack() as stack:
        frame = _training_frame(
            *args, **options, keep=lambda df: stack.enter_context(kept(df, "training"))
        )
        yield frame


def _training_frame(
    train: DataFrame,
    label_col: str,
    seed: int,
    folds: int | None,
    stratified: bool,
    features: Sequence[str],
    partitions: int,
    max_training_rows: int | None,
    validation_col: str | None = None,
    *,
    keep: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    held_back = [F.coalesce(F.col(c), F.lit(False)) for c in [validation_col] if c]
    rows = train.select(
        TEAM,
        *features,
        F.col(label_col).alias(LABEL),
        *(c.alias(VALIDATION) for c in held_back),
        *(["fold"] if folds and "fold" in train.columns else []),
    )
    if max_training_rows is not None and (n := rows.count()) > max_training_rows:
        bound = int(HASH_RANGE * max_training_rows / n)
        rows = rows.where(key_hash(TEAM, f"sample:{seed}") < bound)
    if folds and "fold" not in rows.columns:
        if stratified:
            rows = stratified_folds(keep(rows), LABEL, folds, seed)
        else:
            rows = with_folds(rows, folds, seed)
    frame = keep(rows)
    labels = frame.agg(F.min(LABEL).alias("low"), F.max(LABEL).alias("high")).first()
    if labels.low is None or labels.low == labels.high:
        raise ValueError(f"{label_col} needs both classes among the training rows")
    return frame.repartition(partitions, TEAM).sortWithinPartitions(TEAM)


def param_grid(classifier: Estimator, grid: Mapping[str, Iterable]) -> list[dict]:
    """Every combination of ``grid``; the last parameter varies fastest."""
    builder = ParamGridBuilder()
    for name, values in _checked(dict(grid)).items():
        builder = builder.addGrid(classifier.getParam(name), list(values))
    return builder.build()


def grid_search(
    train: DataFrame,
    grid: Mapping[str, Iterable] = FULL_GRID,
    classifier: Estimator | None = None,
    label_col: str = "Target1",
    folds: int = 3,
    parallelism: int = 4,
    seed: int = 0,
    stratified: bool = True,
    features: Sequence[str] = FEATURES,
    partitions: int = PARTITIONS,
    max_training_rows: int | None = None,
) -> GridSearch:
    """Cross-validated search for the parameters with the best mean accuracy.

    :func:`training_frame` tells how the folds come about. ``parallelism``
    models are trained at a time. The rows kept for the search are deleted after it.

    Where parameters are nested (``NESTED``), a fold is fitted once for all their values,
    with the largest ones. A forest of n trees is the first n of the largest, and a tree of
    depth d a deeper one cut there; with all features and no bootstrap sample it is the
    tree that a fit of that depth gives, and else one drawn in the same way. A boosted model
    of k rounds is the first k of a longer run. The best model is fitted by itself.
    """
    classifier = forest(seed) if classifier is None else classifier
    grid = {name: list(values) for name, values in _checked(dict(grid)).items()}
    tried = [dict(zip(grid, values)) for values in product(*grid.values())]
    nested = [p for p in NESTED.get(type(classifier), ()) if p in grid]
    with _training(
        train, label_col, seed, folds, stratified, features, partitions, max_training_rows
    ) as frame:
        if nested:
            found = _nested_accuracies(
                frame, grid, nested, classifier, folds, parallelism, features
            )
            accuracies = [found[tuple(c.values())] for c in tried]
        else:
            accuracies = _accuracies(frame, grid, classifier, folds, parallelism, features)
        best = max(range(len(tried)), key=accuracies.__getitem__)
        chosen = classifier.copy({classifier.getParam(n): v for n, v in tried[best].items()})
        model = build_pipeline(chosen, features).fit(frame.drop("fold"))
    results = train.sparkSession.createDataFrame(
        [(i, *c.values(), float(accuracies[i])) for i, c in enumerate(tried)],
        ["combination", *grid, "mean_accuracy"],
    )
    return GridSearch(tried[best], results, model)


def _accuracies(
    frame: DataFrame,
    grid: Mapping[str, Sequence],
    classifier: Estimator,
    folds: int,
    parallelism: int,
    features: Sequence[str],
) -> list[float]:
    """Mean accuracy of each combination of ``grid``, every one fitted in every fold."""
    search = CrossValidator(
        estimator=build_pipeline(classifier, features),
        estimatorParamMaps=param_grid(classifier, grid),
        evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return search.fit(frame).avgMetrics


def _nested_accuracies(
    frame: DataFrame,
    grid: Mapping[str, Sequence],
    nested: Sequence[str],
    classifier: Estimator,
    folds: int,
    parallelism: int,
    features: Sequence[str],
) -> dict[tuple, float]:
    """The same by combination, with one fit for all values of ``nested`` parameters.

    Trees of a forest answer to their folds where they are grown. Others are written, and one
    job has all of them answer.
    """
    single = {name: values for name, values in grid.items() if name not in nested}
    outer = [dict(zip(single, values)) for values in product(*single.values())]
    largest = {name: max(grid[name]) for name in nested}
    votes = isinstance(classifier, Forest)
    size = "numTrees" if votes else "maxIter"
    counts = sorted(set(grid.get(size) or [classifier.getOrDefault(size)]))
    depths = sorted(set(grid["maxDepth"])) if "maxDepth" in nested else [None]
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    fits = [classifier.copy(_named(classifier, {**o, **largest})) for o in outer]
    with ExitStack() as stack:
        # Every fit reads the sorted rows several times.
        vectors = assembler.transform(frame).persist()
        stack.callback(vectors.unpersist)
        by_fold = votes and _binned_folds(fits, vectors, folds, stack)
        if by_fold and all(rows.rows <= rows.limit for rows in by_fold):
            parts = [accuracies(fits, rows, counts, depths) for rows in by_fold]
            scores = _by_fold(parts, folds)
        else:
            if by_fold:
                parts = [search_nodes(nodes_of(fits, rows, stack)) for rows in by_fold]
                nodes = stack.enter_context(kept(_by_fold(parts, folds), "nodes"))
            else:
                nodes = _fitted_nodes(fits, vectors, folds, parallelism, stack)
            scores = _answered(
                nodes, frame, assembler, len(outer), folds, counts, depths, votes, stack
            )
        # One row for each combination and fold.
        found = scores.collect()
    total: dict[tuple, float] = {}
    for row in sorted(found, key=lambda r: r.fit):
        params = {"maxDepth": row.depth, size: row["count"]}
        params.update(outer[row.fit // folds])
        key = tuple(params[name] for name in grid)
        total[key] = total.get(key, 0.0) + row.accuracy / folds
    return total


def _named(classifier: Estimator, params: Mapping[str, Any]) -> dict:
    return {classifier.getParam(name): value for name, value in params.items()}


def _binned_folds(
    forests: Sequence[Forest], vectors: DataFrame, folds: int, stack: ExitStack
) -> list[Binned] | None:
    """Rows without each fold, and that fold held out; None if Spark has to fit the forests."""
    found = []
    for fold in range(folds):
        own = vectors.where(F.col("fold").isNotNull())
        rows = binned(forests, own, stack, F.col("fold") == fold)
        if rows is None:
            return None
        found.append(rows)
    return found


def _by_fold(parts: Sequence[DataFrame], folds: int) -> DataFrame:
    """One table of what each fold has, with a number for each fit and fold. One job makes it."""
    numbered = (
        part.withColumn("fit", F.col("fit") * folds + fold) for fold, part in enumerate(parts)
    )
    return reduce(DataFrame.union, numbered)


def _fitted_nodes(
    fits: Sequence[Estimator], vectors: DataFrame, folds: int, parallelism: int, stack: ExitStack
) -> DataFrame:
    """Nodes of all models, each fitted by Spark without each fold."""
    spark = vectors.sparkSession
    folder = scratch_path(spark, "search")
    stack.callback(remove, spark, folder)

    def fit(number: int) -> None:
        train = vectors.where(F.col("fold") != number % folds)
        save_nodes(fits[number // folds].fit(train), f"{folder}/fit={number}")

    with ThreadPool(max(1, parallelism)) as pool:
        pool.map(inheritable_thread_target(spark)(fit), range(len(fits) * folds), 1)
    return read_nodes(spark, folder, several=True)


def _answered(
    nodes: DataFrame, frame: DataFrame, assembler: VectorAssembler, n_outer: int, folds: int,
    counts: Sequence[int], depths: Sequence[int | None], votes: bool, stack: ExitStack,
) -> DataFrame:
    """What share of its fold each fit gets right, by depth and count, from the table of nodes."""
    numbered = frame.withColumn("_row", F.monotonically_increasing_id())
    rows = stack.enter_context(kept(numbered, "folds"))
    each = F.transform(
        F.sequence(F.lit(0), F.lit(n_outer - 1)),
        lambda i: (i * folds + F.col("fold")).cast("int"),
    )
    held_out = assembler.transform(rows).select("_row", "features", F.explode(each).alias("fit"))
    sums = tree_sums(held_out, nodes, counts, depths)
    # Trees of a forest give shares, those of a boosted model add up to a margin.
    least = F.col("count") * 0.5 if votes else F.lit(0.0)
    guess = (F.col("total") > least).cast("int")
    return (
        sums.join(rows.select("_row", LABEL), "_row")
        .groupBy("fit", "depth", "count")
        .agg(F.avg((guess == F.col(LABEL)).cast("int")).alias("accuracy"))
    )


def train_model(
    train: DataFrame,
    classifier: Estimator,
    label_col: str = "Target1",
    seed: int = 0,
    features: Sequence[str] = FEATURES,
    partitions: int = PARTITIONS,
    max_training_rows: int | None = None,
    validation_col: str | None = None,
    exact_bins: int | None = None,
) -> PipelineModel:
    """Fit one classifier on the training rows, all of them by default.

    ``exact_bins`` has trees split at the borders of so many bins of each feature, found
    from all rows (:func:`~tenuro.plans.bins.borders`), instead of Spark's sample.
    ``validation_col`` (boolean; null is false) holds rows back from boosted trees: no
    further round is added once it lowers their error by less than ``validationTol``.
    """
    if validation_col is not None:
        if not isinstance(classifier, GBTClassifier):
            raise ValueError("only boosted trees stop early, by a validation column")
        classifier = classifier.copy({classifier.validationIndicatorCol: VALIDATION})
    with _training(
        train, label_col, seed, None, True, features, partitions, max_training_rows,
        validation_col,
    ) as frame:
        if exact_bins is None:
            return build_pipeline(classifier, features).fit(frame)
        stages, numbers = bin_stages(frame, features, exact_bins)
        binned = PipelineModel(stages).transform(frame)
        fitted = build_pipeline(classifier, numbers).fit(binned)
        return PipelineModel([*stages, *fitted.stages])


def train_forest(
    train: DataFrame,
    params: Mapping[str, Any],
    label_col: str = "Target1",
    seed: int = 0,
    **options,
) -> PipelineModel:
    """Fit the final forest with parameters found by :func:`grid_search`.

    ``options`` are those of :func:`train_model`.
    """
    return train_model(train, forest(seed, **params), label_col, seed, **options)


def staged_accuracy(
    model: PipelineModel, rows: DataFrame, label_col: str = "Target1"
) -> DataFrame:
    """Share of ``rows`` that a boosted model gets right after each round.

    Columns ``rounds`` and ``accuracy``. Each tree answers once, whatever the number of
    rounds, and one without labels counts as wrong.
    """
    trees = ensemble(model)
    if not isinstance(trees, GBTClassificationModel):
        raise ValueError("only boosted models have rounds")
    with_row = written(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    counts = range(1, trees.getNumTrees + 1)
    sums = tree_sums(assembled(model, with_row), node_table(model), counts)
    guess = (F.col("total") > 0).cast("int")
    right = F.coalesce((guess == F.col(label_col)).cast("int"), F.lit(0))
    return (
        sums.join(with_row.select("_row", label_col), "_row")
        .groupBy(F.col("count").alias("rounds"))
        .agg(F.avg(right).alias("accuracy"))
    )


def _checked(params: dict) -> dict:
    depths = params.get("maxDepth", ())
    for depth in [depths] if isinstance(depths, int) else depths:
        if depth > MAX_DEPTH:
            raise ValueError(f"maxDepth is at most {MAX_DEPTH}, not {depth}")
    return params
