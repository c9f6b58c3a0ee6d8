"""Node tables: smaller models from larger ones, importances, scoring in batches."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__ as entry
import tenuro as t
from tenuro.functions import materialise
from tenuro.plans import trees
from tenuro.plans.modelling import LABEL, training_frame
from tenuro.schema import FEATURES
from tests.tables import rows_of

#: Trees that depend on their rows alone.
FIXED = {"featureSubsetStrategy": "all", "bootstrap": False}


@pytest.fixture(scope="module")
def dataset(spark):
    return materialise(t.with_split(entry._dataset(spark, "/root/testdata/sf0.001")))


@pytest.fixture(scope="module")
def train(dataset):
    return t.training_rows(dataset)


@pytest.fixture(scope="module")
def model(train):
    return t.train_forest(
        train, {"numTrees": 12, "maxDepth": 6, "featureSubsetStrategy": "5"}, seed=3
    )


@pytest.fixture(scope="module")
def boosted(train):
    return t.train_model(train, t.boosted_trees(maxIter=6, maxDepth=2))


def scores(df):
    return {r.team_id: r.churn_probability for r in df.collect()}


def test_prefixes_are_forests_of_the_first_trees(dataset, model):
    rows = dataset.select("team_id", *FEATURES).withColumn("_row", F.col("team_id"))
    vectors = trees.assembled(model, rows)
    sums = trees.tree_sums(vectors, t.node_table(model), counts=(1, 5, 12))
    got = {(r["_row"], r["count"]): r.total for r in sums.collect()}
    first = model.stages[1].trees
    for row in rows.limit(20).collect():
        vector = Vectors.dense([row[f] for f in FEATURES])
        said = [tree.predict(vector) for tree in first]
        for n in (1, 5, 12):
            assert got[row.team_id, n] == pytest.approx(sum(said[:n]), abs=1e-12)


def test_cut_trees_are_those_of_lesser_depth(train):
    """Where trees don't draw features or rows, the search equals separate fits."""
    for size in (1, 3):
        fixed = {**FIXED, "numTrees": size}
        found = t.grid_search(train, {"maxDepth": (1, 2, 4, 6)}, t.forest(**fixed))
        apart = t.grid_search(  # a parameter that isn't nested has each depth fitted
            train, {"minInstancesPerNode": (1,)}, t.forest(**fixed, maxDepth=4)
        )
        assert [r.maxDepth for r in found.results.orderBy("combination").collect()] == [1, 2, 4, 6]
        (accuracy,) = [r.mean_accuracy for r in apart.results.collect()]
        (cut,) = [r.mean_accuracy for r in found.results.where("maxDepth = 4").collect()]
        assert cut == pytest.approx(accuracy, abs=1e-12)


def test_search_by_trees_depths_and_shares(train):
    grid = {"maxDepth": (2, 5), "featureSubsetStrategy": ("2", "9"), "numTrees": (2, 4, 8)}
    found = t.grid_search(train, grid, seed=1)
    rows = found.results.orderBy("combination").collect()
    expected = [(d, s, n) for d in grid["maxDepth"] for s in ("2", "9") for n in (2, 4, 8)]
    assert [tuple(r)[1:4] for r in rows] == expected
    best = max(rows, key=lambda r: (r.mean_accuracy, -r.combination))
    assert found.best_params == dict(zip(grid, tuple(best)[1:4]))
    trained = t.train_forest(train, found.best_params, seed=1)
    best_trees, trained_trees = (
        [tree.toDebugString.split("\n")[1:] for tree in m.stages[1].trees]
        for m in (found.best_model, trained)
    )
    assert best_trees == trained_trees
    # The accuracies of the deepest, largest forests are those of fits of just that kind.
    frame = training_frame(train, folds=3, seed=1)
    total = 0
    for fold in range(3):
        pipeline = t.build_pipeline(t.forest(1, maxDepth=5, numTrees=8, featureSubsetStrategy="9"))
        fitted = pipeline.fit(frame.where(F.col("fold") != fold))
        guess = fitted.transform(frame.where(F.col("fold") == fold))
        total += guess.agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("int"))).first()[0] / 3
    assert rows[-1].mean_accuracy == pytest.approx(total, abs=1e-12)


def test_boosting_rounds_from_one_fit(train, boosted):
    grid = {"maxDepth": (1, 2), "maxIter": (1, 3, 6)}
    nested = t.grid_search(train, grid, t.boosted_trees())
    # Named one at a time, rounds can't be shared.
    for row in nested.results.where("maxDepth = 2").collect():
        apart = t.grid_search(
            train, {"stepSize": (0.1,)}, t.boosted_trees(maxIter=row.maxIter, maxDepth=2)
        )
        (accuracy,) = [r.mean_accuracy for r in apart.results.collect()]
        assert row.mean_accuracy == pytest.approx(accuracy, abs=1e-12)
    staged = {r.rounds: r.accuracy for r in t.staged_accuracy(boosted, train).collect()}
    assert sorted(staged) == [1, 2, 3, 4, 5, 6]
    for rounds in (1, 4):
        shorter = t.train_model(train, t.boosted_trees(maxIter=rounds, maxDepth=2))
        guess = t.predict_classes(shorter, train)
        right = guess.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
        assert staged[rounds] == pytest.approx(right, abs=1e-12)


def test_boosting_stops_early(train):
    marked = train.withColumn("late", F.col("team_id") % 4 == 0)
    options = dict(maxIter=40, maxDepth=4, stepSize=1.0, validationTol=0.01)
    early = t.train_model(marked, t.boosted_trees(**options), validation_col="late")
    assert early.stages[1].getNumTrees < 40
    with pytest.raises(ValueError, match="boosted"):
        t.train_model(marked, t.forest(), validation_col="late")
    with pytest.raises(ValueError, match="rounds"):
        t.staged_accuracy(t.train_forest(train, {"numTrees": 1, "maxDepth": 1}), train)


def test_importance_is_that_of_the_model(model, boosted):
    for fitted, alike in ((model, True), (boosted, False)):
        own = {r.feature: r.importance for r in t.feature_importance(fitted).collect()}
        table = t.node_importance(t.node_table(fitted), alike=alike)
        got = {r.feature: r.importance for r in table.collect()}
        assert got.keys() == own.keys()
        assert all(got[f] == pytest.approx(own[f], abs=1e-12) for f in own)
        assert sum(got.values()) == pytest.approx(1)


def test_importance_without_a_split(train):
    never = t.train_forest(train, {"numTrees": 2, "minInstancesPerNode": 10**9})
    assert {r.importance for r in t.node_importance(t.node_table(never)).collect()} == {0.0}


@pytest.mark.parametrize("batch_bytes,block_rows", [(64 << 20, 100_000), (2000, 40), (1, 1000)])
def test_scores_in_batches(dataset, model, boosted, batch_bytes, block_rows):
    for fitted in (model, boosted):
        whole = scores(t.score(fitted, dataset))
        df = t.score_in_batches(fitted, dataset, batch_bytes, block_rows)
        assert df.columns == [*dataset.columns, "churn_probability"]
        got = scores(df)
        assert got.keys() == whole.keys()
        assert all(got[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_scores_in_batches_of_odd_rows(spark, dataset, model):
    row = dataset.limit(1)
    odd = row.union(row).withColumns({"_row": F.lit("a"), "a.b": F.lit(1), "team_id": F.lit(None).cast("bigint")})
    got = t.score_in_batches(model, odd, batch_bytes=1000)
    assert got.columns == [*odd.columns, "churn_probability"]
    (expected,) = [r.churn_probability for r in t.score(model, row).collect()]
    assert [r.churn_probability for r in got.collect()] == [pytest.approx(expected, abs=1e-9)] * 2
    assert t.score_in_batches(model, dataset.limit(0)).count() == 0
    with pytest.raises(Exception, match="null"):
        t.score_in_batches(model, dataset.withColumn(FEATURES[0], F.lit(None).cast("double"))).collect()


def test_batches_are_bounded(spark, model):
    nodes = t.node_table(model)
    batched = trees._in_batches(nodes, [], 4000)
    sizes = [r["count"] * trees.NODE_BYTES for r in batched.groupBy("batch").count().collect()]
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] * trees.NODE_BYTES
    assert len(sizes) > 2 and max(sizes) < 4000 + largest
    assert rows_of(batched.drop("batch")) == rows_of(nodes)


def test_no_rows_of_trees_reach_the_driver(spark, dataset, model, monkeypatch):
    def refuse(*_):
        raise AssertionError("collected")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", refuse)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", refuse)
    scored = t.score_in_batches(model, dataset)
    assert scored.count() == dataset.count()
