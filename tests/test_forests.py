"""Forests grown from binned rows, against Spark's own trees."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry
import tenuro as t
from tenuro.functions import lineage, materialise
from tenuro.plans import forests
from tenuro.plans.modelling import training_frame
from tenuro.schema import FEATURES

DRAWN = {"numTrees": 6, "featureSubsetStrategy": "9"}


@pytest.fixture(scope="module")
def train(spark):
    dataset = t.with_split(entry._dataset(spark, "/root/testdata/sf0.01"))
    return materialise(t.training_rows(dataset))


def shapes(model):
    return [tree.toDebugString.split("\n")[1:] for tree in model.stages[1].trees]


def test_trees_without_draws_are_sparks(train):
    features = entry.PLAN_FEATURES  # few values, so that bins are the same
    frame = training_frame(train, features=features)
    fixed = dict(numTrees=2, maxDepth=5, bootstrap=False, featureSubsetStrategy="all", minInstancesPerNode=3)
    own = t.build_pipeline(t.forest(**fixed), features).fit(frame)
    sparks = RandomForestRegressor(labelCol="label", **fixed)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    other = Pipeline(stages=[assembler, sparks]).fit(frame)
    assert shapes(own) == shapes(other) and len(shapes(own)[0]) > 10
    importances = [m.stages[1].featureImportances.toArray() for m in (own, other)]
    assert importances[0] == pytest.approx(importances[1], abs=1e-12)


def test_rows_that_no_task_can_hold_give_the_same_forest(train, monkeypatch):
    whole = t.train_forest(train, {**DRAWN, "maxDepth": 7}, seed=4)
    rows = train.count()
    for share in (3,):
        monkeypatch.setattr(forests, "GROUP_BYTES", (len(FEATURES) + 1) * rows // share)
        assert shapes(t.train_forest(train, {**DRAWN, "maxDepth": 7}, seed=4)) == shapes(whole)


def test_few_nodes_at_a_time_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 8, (3000, 6)).astype(np.uint8)
    labels = (rng.random(3000) < 0.1 + 0.1 * codes[:, 0]).astype(np.uint8)
    for tried in (1, 4, 6):
        spec = forests.Spec(1, 12, tried, 3, True, 1.0, 1, 0.0)
        copies = forests._copies(spec, 0, 0, 0, 3000)
        grown = []
        for n in (4096, 3):
            monkeypatch.setattr(forests, "NODES_AT_A_TIME", n)
            grown.append(forests._grow(codes, labels, copies, spec, 0, 8))
        order = [np.argsort(g.path) for g in grown]
        for one, other in zip(*grown):
            assert (one[order[0]] == other[order[1]]).all()


def test_a_cut_tree_is_that_of_lesser_depth_with_draws_too(train):
    grid = {"maxDepth": (2, 6), "numTrees": (3, 6), "featureSubsetStrategy": ("3",)}
    found = t.grid_search(train, grid, seed=5)
    frame = training_frame(train, folds=3, seed=5)
    (row,) = found.results.where("maxDepth = 2 AND numTrees = 3").collect()
    total = 0
    for fold in range(3):
        forest = t.forest(5, **{n: row[n] for n in grid})
        fitted = t.build_pipeline(forest).fit(frame.where(F.col("fold") != fold))
        guess = fitted.transform(frame.where(F.col("fold") == fold))
        total += guess.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] / 3
    assert row.mean_accuracy == pytest.approx(total, abs=1e-12)


SEARCH = {"maxDepth": (2, 7), "featureSubsetStrategy": ("3", "20"), "numTrees": (2, 5, 9)}


@pytest.fixture(scope="module")
def searched(train):
    return t.grid_search(train, SEARCH, seed=3).results.collect()


@pytest.mark.parametrize("label", ["Target1", "Target2"])
def test_a_search_writes_no_trees(train, monkeypatch, label):
    names = []
    path = lineage.scratch_path
    monkeypatch.setattr(lineage, "scratch_path", lambda s, n: names.append(n) or path(s, n))
    t.grid_search(train, {"maxDepth": (2, 4), "numTrees": (2, 3)}, label_col=label)
    assert "blocks" in names and not {"nodes", "tree-batches"} & set(names)


def test_a_search_by_the_table_of_nodes_finds_the_same(train, searched, monkeypatch):
    rows = train.count()
    monkeypatch.setattr(forests, "GROUP_BYTES", (len(FEATURES) + 1) * rows // 3)
    found = t.grid_search(train, SEARCH, seed=3).results.collect()
    for one, other in zip(found, searched, strict=True):
        assert one[:-1] == other[:-1]
        assert one.mean_accuracy == pytest.approx(other.mean_accuracy, abs=1e-12)
    assert len({r.mean_accuracy for r in found}) > 6


def test_a_search_does_not_depend_on_its_tasks(train, searched, monkeypatch):
    monkeypatch.setattr(forests, "TREES_PER_TASK", 1)
    monkeypatch.setattr(forests, "SEARCH_TASKS", 7)
    assert t.grid_search(train, SEARCH, seed=3).results.collect() == searched


def test_held_out_rows_have_blocks_of_their_own(monkeypatch):
    monkeypatch.setattr(forests, "BLOCK_ROWS", 4)
    context = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 5))
    monkeypatch.setattr(forests, "TaskContext", context)
    numbers = np.arange(23)
    held = numbers % 3 == 1
    rows = pa.record_batch({
        "values": [[float(i), 0.0] for i in numbers], "label": (numbers % 2).astype(float), "held": held,
    })
    batches = [rows.slice(i, 5) for i in range(0, 23, 5)]
    places = [np.arange(22) + 0.5, np.empty(0)]
    found = pa.Table.from_batches(forests._pack(batches, places)).to_pylist()
    for side in (False, True):
        own = [b for b in found if b["held"] == side]
        assert [b["block"] for b in own] == list(range(len(own)))
        assert {b["n"] for b in own[:-1]} == {4} and {b["part"] for b in own} == {5}
        codes = np.frombuffer(b"".join(b["codes"] for b in own), np.uint8).reshape(-1, 2)
        assert codes[:, 0].tolist() == numbers[held == side].tolist() and not codes[:, 1].any()
        labels = np.frombuffer(b"".join(b["labels"] for b in own), np.uint8)
        assert (labels == codes[:, 0] % 2).all()


def test_forests_learn_as_well_as_sparks(train):
    parts = [train.where(F.col("team_id") % 2 == i) for i in (0, 1)]
    params = dict(numTrees=30, maxDepth=6, featureSubsetStrategy="9")
    frame = training_frame(parts[0])
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sparks = RandomForestRegressor(labelCol="label", predictionCol="leave_share", **params, seed=1)
    models = [
        t.build_pipeline(t.forest(1, **params)).fit(frame),
        Pipeline(stages=[assembler, sparks]).fit(frame),
    ]
    errors = [
        m.transform(parts[1]).agg(F.avg((F.col("leave_share") - F.col("Target1")) ** 2)).first()[0]
        for m in models
    ]
    assert errors[0] < 1.1 * errors[1]


def test_other_labels_are_left_to_spark(spark):
    rows = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).alias("label"))
    vectors = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    fitted = forests.Forest(labelCol="label", numTrees=2).fit(vectors)
    assert {r.prediction for r in fitted.transform(vectors).collect()} - {0.0, 1.0}
