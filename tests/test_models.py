"""Training, evaluation and scoring."""

from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
import tenuro as t
from tenuro.functions import materialise, shared_folder
from tenuro.schema import DATASET, FEATURES
from tests.tables import rows_of

PARAMS = {"numTrees": 5, "maxDepth": 3, "featureSubsetStrategy": t.max_features(0.5)}


@pytest.fixture(scope="module")
def dataset(spark):
    return materialise(t.with_split(entry._dataset(spark, "/root/testdata/sf0.001")))


@pytest.fixture(scope="module")
def model(dataset):
    return t.train_forest(t.training_rows(dataset), PARAMS, seed=1)


def test_full_grid(spark):
    grid = t.param_grid(t.forest(), t.FULL_GRID)
    assert len(grid) == 90
    tried = [{p.name: v for p, v in c.items()} for c in grid]
    assert tried[0] == {
        "maxDepth": 5, "featureSubsetStrategy": "2", "numTrees": 100
    }
    assert [c["numTrees"] for c in tried[:4]] == [100, 500, 1000, 100]
    assert [c["maxDepth"] for c in tried[29:31]] == [5, 10]
    assert tried[-1]["featureSubsetStrategy"] == "28"


def test_max_features_rounds_down_to_at_least_one():
    assert [t.max_features(f) for f in (0.01, 0.1, 0.3, 0.9, 1.0)] == [
        "1", "2", "8", "25", "28"
    ]


def test_depth_limit(spark):
    with pytest.raises(ValueError, match="at most 30"):
        t.forest(maxDepth=31)
    with pytest.raises(ValueError, match="at most 30"):
        t.param_grid(t.forest(), {"maxDepth": (5, 31)})


def test_scores(dataset, model):
    scored = t.score(model, dataset)
    assert scored.columns == [*DATASET, "is_train", "churn_probability"]
    assert scored.count() == dataset.count()
    assert scored.where(~F.col("churn_probability").between(0, 1)).count() == 0
    spread = t.score(model, dataset, partitions=5)
    assert rows_of(spread) == rows_of(scored)
    assert spread.rdd.getNumPartitions() == 5


def test_predictions_and_report(dataset, model):
    held_out = t.holdout_rows(dataset)
    predictions = t.predict_classes(model, held_out)
    assert rows_of(predictions, "team_id", "label") == rows_of(
        held_out, "team_id", "Target1"
    )
    cells = t.confusion_matrix(predictions).collect()
    assert sum(r.predicted_0 + r.predicted_1 for r in cells) == held_out.count()


def test_importance(model):
    importance = t.feature_importance(model)
    rows = {r.feature: r.importance for r in importance.collect()}
    assert list(rows) == list(FEATURES)
    assert sum(rows.values()) == pytest.approx(1)
    top = [tuple(r) for r in t.rank_features(importance, top=8).collect()]
    assert top == [
        (f, pytest.approx(100 * i))
        for f, i in sorted(rows.items(), key=lambda x: (-x[1], x[0]))[:8]
    ]
    assert t.rank_features(importance).count() == 28


def test_same_seed_same_model(dataset, model):
    again = t.train_forest(
        t.training_rows(dataset).repartition(9), PARAMS, seed=1
    )
    assert rows_of(t.score(again, dataset)) == rows_of(t.score(model, dataset))


def test_shuffle_settings_do_not_change_the_model(dataset, model, conf):
    for partitions in ("3", "7"):
        conf("spark.sql.shuffle.partitions", partitions)
        again = t.train_forest(t.training_rows(dataset), PARAMS, seed=1)
        assert rows_of(t.score(again, dataset)) == rows_of(t.score(model, dataset))
    other = t.train_forest(t.training_rows(dataset), PARAMS, seed=1, partitions=2)
    assert rows_of(t.score(other, dataset)) != rows_of(t.score(model, dataset))


def test_leaves_of_one_class_stay_apart(spark):
    rows = [(i, int(i % 5 < (2 if i < 500 else 1)), int(i < 500)) for i in range(1000)]
    df = spark.createDataFrame(rows, "team_id long, Target1 int, quantity int")
    stump = {
        "maxDepth": 1, "numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all"
    }
    fitted = t.train_forest(df, stump, features=("quantity",))
    shares = t.score(fitted, df).select("quantity", "churn_probability").distinct()
    assert rows_of(shares) == [(0, pytest.approx(0.2)), (1, pytest.approx(0.4))]
    assert {r.prediction for r in t.predict_classes(fitted, df).collect()} == {0}
    assert t.feature_importance(fitted, ("quantity",)).first().importance == 1


def test_the_search_gives_the_model_of_its_best_parameters(dataset):
    train = t.training_rows(dataset)
    found = t.grid_search(train, {"maxDepth": (2, 3), "numTrees": (3,)}, seed=0)
    same = t.train_forest(train, found.best_params)
    assert rows_of(t.score(found.best_model, dataset)) == rows_of(t.score(same, dataset))


def test_nothing_stays_after_training(spark, dataset):
    def kept():
        folder = Path(shared_folder(spark)) / f"scratch-{spark.sparkContext.applicationId}"
        return {p.name for p in folder.glob("training*")}

    before = kept()
    t.grid_search(t.training_rows(dataset), {"numTrees": (2,), "maxDepth": (2,)})
    t.train_forest(t.training_rows(dataset), PARAMS)
    assert kept() == before


def test_training_rows_may_be_bounded(dataset):
    train = t.training_rows(dataset)
    frame = t.training_frame(train, max_training_rows=50)
    assert 20 <= frame.count() <= 80
    assert t.training_frame(train, max_training_rows=10**6).count() == train.count()


def test_grid_search_picks_the_first_best(dataset):
    grid = {"maxDepth": (1, 2), "numTrees": (2, 3)}
    found = t.grid_search(t.training_rows(dataset), grid)
    rows = found.results.orderBy("combination").collect()
    best = max(rows, key=lambda r: (r.mean_accuracy, -r.combination))
    assert found.best_params == {"maxDepth": best.maxDepth, "numTrees": best.numTrees}
    assert len(rows) == 4 and all(0 <= r.mean_accuracy <= 1 for r in rows)


@pytest.mark.parametrize("stratified", [True, False])
def test_grid_search_on_second_label(dataset, stratified):
    found = t.grid_search(
        t.training_rows(dataset),
        {"numTrees": (2,)},
        label_col="Target2",
        folds=2,
        stratified=stratified,
    )
    assert found.best_params == {"numTrees": 2}


def test_folds_of_the_training_frame(dataset):
    train = t.training_rows(dataset)
    sizes = t.training_frame(train, folds=3).groupBy("label").pivot("fold").count()
    for row in sizes.collect():
        assert max(row[1:]) - min(row[1:]) <= 1
    assert "fold" not in t.training_frame(train).columns
    given = train.withColumn("fold", F.lit(1))
    frame = t.training_frame(given, folds=3)
    assert [tuple(r) for r in frame.select("fold").distinct().collect()] == [(1,)]


@pytest.mark.parametrize(
    "classifier, params",
    [(t.logistic, {"maxIter": 5}), (t.boosted_trees, {"maxIter": 2, "maxDepth": 2})],
)
def test_other_models(dataset, classifier, params):
    model = t.train_model(t.training_rows(dataset), classifier(**params))
    scored = t.score(model, dataset)
    assert scored.where(~F.col("churn_probability").between(0, 1)).count() == 0


def test_from_files_to_probabilities(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for name, make in (("l", entry._licenses), ("a", entry._activity)):
        make(spark, folder).write.csv(f"{tmp_path}/{name}", header=True, nullValue="NA")
    licenses = t.read_licenses(spark, f"{tmp_path}/l")
    activity = t.read_activity(spark, f"{tmp_path}/a")
    dataset = materialise(
        t.with_split(t.prediction_dataset(licenses, activity, "2002-01-01"))
    )
    search = t.grid_search(
        t.training_rows(dataset), {"maxDepth": (2,), "numTrees": (3, 4)}
    )
    model = t.train_forest(t.training_rows(dataset), search.best_params)
    report = t.classification_report(
        t.predict_classes(model, t.holdout_rows(dataset))
    )
    assert [r["class"] for r in report.collect()] == [
        "0", "1", "accuracy", "macro avg", "weighted avg"
    ]
    scored = t.score(model, dataset)
    assert scored.count() == 135
    assert scored.where("churn_probability is null").count() == 0


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_is_an_error(dataset, label):
    with pytest.raises(ValueError, match="both classes"):
        t.train_forest(dataset.where(F.col("Target1") == label), PARAMS)


def test_null_feature_is_an_error(dataset, model):
    holed = dataset.withColumn("quantity", F.lit(None).cast("bigint"))
    with pytest.raises((PySparkException, Py4JJavaError), match="null"):
        t.score(model, holed).collect()
