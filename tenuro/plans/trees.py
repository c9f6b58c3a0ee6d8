"""Fitted trees as a table of nodes: what one fit says about smaller models, importances,
and scoring without a whole model in any task.

A forest of n trees is the first n of a larger one, and a tree of depth d is a deeper one
cut at level d, since every node keeps the mean of its training rows. After k rounds of
boosting a model is the first k trees of a longer run. So one fit of the largest model
holds all smaller ones, and the sums of its trees' answers give the accuracy of each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import JavaMLWritable
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tenuro.functions.lineage import scratch_path, written
from tenuro.schema import FEATURES

#: Nodes of trees: rows are weighted by their copies in the tree's sample; ``left`` and
#: ``feature`` are -1 in leaves, whose ``gain`` doesn't count.
NODE_FIELDS = (
    "tree", "node", "prediction", "gain", "rows", "left", "right", "feature",
    "threshold", "weight",
)
#: Memory that a node takes in a task that scores (fixed value, from the fields below).
NODE_BYTES = 5 * 8
#: Trees that score together in a task take so many bytes at most, or are a single tree.
BATCH_BYTES = 64 << 20
#: About so many rows are scored together in a task.
BLOCK_ROWS = 100_000
_ROW = "_row"


def ensemble(model: PipelineModel):
    """The stage that holds the trees."""
    return next(s for s in model.stages if hasattr(s, "trees"))


def assembled(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``_row`` and the vector ``features`` that the trees of ``model`` see."""
    for stage in model.stages[: model.stages.index(ensemble(model))]:
        rows = stage.transform(rows)
    return rows.select(_ROW, "features")


def save_nodes(trees: JavaMLWritable, path: str) -> None:
    """Write fitted trees; :func:`read_nodes` reads them."""
    trees.write().save(path)


def read_nodes(spark: SparkSession, path: str, several: bool = False) -> DataFrame:
    """The nodes of a saved model: ``NODE_FIELDS``. Splits by categories raise.

    With ``several``, those of all models in folders ``fit=0``, ``fit=1``... of ``path``,
    and their ``fit``.
    """
    reader, fit = spark.read, []
    if several:
        reader, fit = reader.option("basePath", path), ["fit"]
        path = f"{path}/fit=*"
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner = node.leftChild >= 0
    by_category = F.raise_error(F.lit("a tree splits by categories"))
    nodes = reader.parquet(f"{path}/data").select(
        *fit,
        F.col("treeID").alias("tree"),
        node.id.alias("node"),
        node.prediction.alias("prediction"),
        node.gain.alias("gain"),
        node.impurityStats[0].alias("rows"),
        node.leftChild.alias("left"),
        node.rightChild.alias("right"),
        split.featureIndex.alias("feature"),
        F.when(inner & (split.numCategories >= 0), by_category)
        .when(inner, split.leftCategoriesOrThreshold[0])
        .alias("threshold"),
    )
    weights = reader.parquet(f"{path}/treesMetadata").toDF("tree", "_", "weight", *fit)
    return nodes.join(weights.drop("_"), [*fit, "tree"])


def node_table(model: PipelineModel) -> DataFrame:
    """The nodes of a fitted forest or boosted model, from a copy in the shared folder."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    save_nodes(ensemble(model), path)
    return read_nodes(spark, path)


def node_importance(
    nodes: DataFrame, features: Sequence[str] = FEATURES, alike: bool = True
) -> DataFrame:
    """Share of each feature in the decrease of impurity: ``feature``, ``importance``.

    A tree's share is what its splits by the feature gain, by the rows they part. The trees
    of a forest count alike, whatever their gain in all, those of a boosted model by it
    (``alike=False``). Trees without a split don't count, and none with a split gives zeros.
    """
    gained = nodes.where("left >= 0").groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("rows")).alias("gained")
    )
    of_tree = F.sum("gained").over(Window.partitionBy("tree"))
    share = F.when(of_tree != 0, F.col("gained") / of_tree) if alike else F.col("gained")
    shares = (
        gained.withColumn("share", share)
        .groupBy("feature")
        .agg(F.sum("share").alias("share"))
    )
    names = F.array(*map(F.lit, features))
    known = nodes.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("feature"))
    total = F.sum("share").over(Window.partitionBy(F.lit(0)))  # one row for each feature
    return known.join(shares, "feature", "left").select(
        F.element_at(names, F.col("feature") + 1).alias("feature"),
        F.coalesce(F.col("share") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("importance"),
    )


# ---------------------------------------------------------------- answers of trees


class Tree(NamedTuple):
    number: int
    weight: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray


def _trees(table: pa.Table) -> Iterator[Tree]:
    """The trees among the rows of a node table; a node's number is its place."""
    field = {name: table.column(name).to_numpy() for name in NODE_FIELDS}
    order = np.lexsort((field["node"], field["tree"]))
    field = {name: values[order] for name, values in field.items()}
    starts = np.flatnonzero(np.r_[True, field["tree"][1:] != field["tree"][:-1]][: len(order)])
    for start, stop in zip(starts, [*starts[1:], len(order)]):
        own = {name: values[start:stop] for name, values in field.items()}
        yield Tree(
            int(own["tree"][0]), float(own["weight"][0]), own["feature"],
            own["threshold"], own["left"], own["right"], own["prediction"],
        )


def tree_answers(tree: Tree, rows: np.ndarray, depths: Sequence[int | None]) -> np.ndarray:
    """What the tree says to each row if it is cut at each of ``depths``; None: not at all."""
    n, width = rows.shape
    flat = rows.ravel()
    out = np.empty((len(depths), n))
    at, level = np.zeros(n, np.int64), 0
    going = np.arange(n if tree.left[0] >= 0 else 0)
    here = at[: len(going)]
    while True:
        for i, depth in enumerate(depths):
            if depth == level:
                out[i] = tree.prediction.take(at)
        if not len(going):
            break
        low = flat.take(going * width + tree.feature.take(here)) <= tree.threshold.take(here)
        here = np.where(low, tree.left.take(here), tree.right.take(here))
        at[going] = here
        stays = np.flatnonzero(tree.left.take(here) >= 0)
        going, here = going.take(stays), here.take(stays)
        level += 1
    for i, depth in enumerate(depths):
        if depth is None or depth > level:
            out[i] = tree.prediction.take(at)
    return out


def _in_batches(nodes: DataFrame, keys: Sequence[str], batch_bytes: int) -> DataFrame:
    """``nodes`` with a ``batch``: trees in order, of ``batch_bytes`` together."""
    size = nodes.groupBy(*keys, "tree").agg((F.count("*") * NODE_BYTES).alias("size"))
    # One row a tree meets in this window, whatever the number of rows to score.
    each = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("size").over(each.orderBy("tree")) - F.col("size")
    numbered = size.withColumn("place", F.floor(before / batch_bytes))
    batch = F.dense_rank().over(each.orderBy("place")) - 1
    return nodes.join(numbered.select(*keys, "tree", batch.alias("batch")), [*keys, "tree"])


def tree_sums(
    rows: DataFrame,
    nodes: DataFrame,
    counts: Sequence[int] | None = None,
    depths: Sequence[int | None] = (None,),
    batch_bytes: int = BATCH_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Weighted sums of trees' answers to each row: ``_row``, ``depth``, ``count``, ``total``.

    ``rows`` has a column ``_row`` that tells rows apart, and the vector ``features``;
    ``total`` is over the first ``count`` trees, cut at ``depth``. With a column ``fit`` on both sides the
    trees of a fit answer to its own rows only, and ``fit`` is in the result.

    Trees go to tasks in batches of about ``batch_bytes`` (up to twice that, or one tree),
    and rows in blocks of about ``block_rows``. So a task holds one block and one batch,
    however large the model is, and nothing passes through the driver. Rows are moved once
    for each batch.
    """
    keys = ["fit"] if "fit" in rows.columns else []
    cuts = None if counts is None else np.array(sorted(set(counts)))
    levels = list(dict.fromkeys(depths))
    batched = written(_in_batches(nodes, keys, batch_bytes), "tree-batches")
    batches = batched.select(*keys, "batch").distinct()
    n_blocks = F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")
    blocks = rows.groupBy(*keys).agg(n_blocks)

    def with_one(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
        """``df`` with the value of ``one``, which has a row for each fit."""
        return df.join(one, keys) if keys else df.withColumn(name, one.scalar())

    sized = with_one(rows, blocks, "blocks")
    block = F.pmod(F.xxhash64(_ROW), F.greatest("blocks", F.lit(1))).cast("int").alias("block")
    values = vector_to_array("features").alias("values")
    n_batches = batches.groupBy(*keys).agg(F.max("batch").alias("last"))
    each_batch = F.explode(F.sequence(F.lit(0), "last")).alias("batch")
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = with_one(sized.select(*keys, _ROW, block, values), n_batches, "last")
    left = left.select(*keys, _ROW, "block", "values", each_batch)
    right = with_one(batched, blocks, "blocks").where("blocks > 0")
    right = right.select(*keys, "batch", *NODE_FIELDS, each_block)
    place = [*keys, "batch", "block"]
    schema = T.StructType([rows.schema[k] for k in keys])
    schema.add(_ROW, "long").add("depth", "integer").add("cut", "integer").add("total", "double")

    def answer(part: pa.Table, trees: pa.Table) -> pa.Table:
        matrix = part.column("values").combine_chunks().flatten().to_numpy()
        matrix = matrix.reshape(part.num_rows, -1) if part.num_rows else matrix.reshape(0, 1)
        n_cuts = 1 if cuts is None else len(cuts)
        sums = np.zeros((len(levels), n_cuts + 1, part.num_rows))
        for tree in _trees(trees):
            # With the least count that the tree is one of.
            cut = 0 if cuts is None else int(np.searchsorted(cuts, tree.number, side="right"))
            sums[:, cut] += tree.weight * tree_answers(tree, matrix, levels)
        row = part.column(_ROW).to_numpy()
        out = {k: np.repeat(part.column(k).to_numpy()[:1], sums[:, :-1].size) for k in keys}
        depth = np.array([-1 if d is None else d for d in levels], np.int32)
        shape = (len(levels), n_cuts, part.num_rows)
        out[_ROW] = np.broadcast_to(row, shape).ravel()
        out["depth"] = np.broadcast_to(depth[:, None, None], shape).ravel()
        out["cut"] = np.broadcast_to(np.arange(n_cuts, dtype=np.int32)[:, None], shape).ravel()
        out["total"] = np.cumsum(sums[:, :-1], axis=1).ravel()
        return pa.table(out)

    answers = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(answer, schema)
    summed = answers.groupBy(*keys, _ROW, "depth", "cut").agg(F.sum("total").alias("total"))
    n = F.lit(None).cast("int") if cuts is None else F.element_at(
        F.array(*(F.lit(int(c)) for c in cuts)), F.col("cut") + 1
    )
    depth = F.when(F.col("depth") >= 0, F.col("depth"))
    return summed.select(*keys, _ROW, depth.alias("depth"), n.alias("count"), "total")


def score_in_batches(
    model: PipelineModel,
    df: DataFrame,
    batch_bytes: int = BATCH_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """What :func:`~tenuro.plans.scoring.score` gives, without the whole model in any task.

    A task holds about ``batch_bytes`` of trees and ``block_rows`` rows
    (see :func:`tree_sums`). For forests and boosted trees; a null feature raises.
    """
    trees = ensemble(model)
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = written(
        df.toDF(*names).withColumn(_ROW, F.monotonically_increasing_id()), "rows-to-score"
    )
    inputs = rows.select(
        _ROW, *(F.col(n).alias(c) for n, c in zip(names, df.columns) if c != _ROW)
    )
    sums = tree_sums(
        assembled(model, inputs), node_table(model), batch_bytes=batch_bytes, block_rows=block_rows
    )
    if isinstance(trees, GBTClassificationModel):
        share = 1 / (1 + F.exp(-2 * F.col("total")))
    else:
        share = F.col("total") / F.lit(float(trees.getNumTrees))
    scored = rows.join(sums.select(_ROW, share.alias("churn_probability")), _ROW)
    return scored.select(
        *(F.col(n).alias(c) for n, c in zip(names, df.columns)), "churn_probability"
    )
