"""Exact split points, and categories as sparse vectors."""

import random

import pytest
from pyspark.sql import functions as F

import tenuro as t
from tenuro.plans import bins as b


def by_hand(values, bins):
    values = sorted(v for v in values if v is not None and v == v)
    distinct = sorted(set(values))
    if len(distinct) <= bins:
        return [(x + y) / 2 for x, y in zip(distinct, distinct[1:])]
    place = {v: bins * values.index(v) // len(values) for v in distinct}
    return [(x + y) / 2 for x, y in zip(distinct, distinct[1:]) if place[x] != place[y]]


@pytest.fixture(scope="module")
def columns():
    rnd = random.Random(2)
    return {
        "few": [rnd.choice([1, 2, 3, 7]) for _ in range(3000)],
        "skewed": [int(rnd.paretovariate(0.7)) for _ in range(3000)],
        "mostly one": [5 if rnd.random() < 0.9 else rnd.randrange(1000) for _ in range(3000)],
        "real": [rnd.gauss(0, 1) for _ in range(3000)],
        "constant": [4] * 3000,
        "gaps": [None if i % 3 else float("nan") if i % 2 else i for i in range(3000)],
    }


@pytest.fixture(scope="module")
def frame(spark, columns):
    types = ["int", "long", "int", "double", "int", "double"]
    names = ", ".join(f"`{n}` {k}" for n, k in zip(columns, types))
    rows = [
        tuple(float(v) if k == "double" and v is not None else v for v, k in zip(row, types))
        for row in zip(*columns.values())
    ]
    return spark.createDataFrame(rows, names).repartition(7)


@pytest.mark.parametrize("bins", [2, 4, 32])
@pytest.mark.parametrize("ranges", [3, 256])
def test_borders_are_exact(frame, columns, monkeypatch, bins, ranges):
    monkeypatch.setattr(b, "RANGES", ranges)
    got = b.borders(frame, list(columns), bins)
    assert got == {name: pytest.approx(by_hand(v, bins)) for name, v in columns.items()}
    assert all(len(places) < bins for places in got.values())


def test_borders_of_nothing(frame):
    assert b.borders(frame.limit(0), ["few"]) == {"few": []}
    with pytest.raises(ValueError, match="two bins"):
        b.borders(frame, ["few"], 1)


def test_trees_split_at_exact_borders(spark):
    """One value in a thousand decides, which a sample may miss."""
    rows = spark.range(40_000).select(
        F.col("id").alias("team_id"),
        F.when(F.col("id") % 1000 == 0, 1).otherwise(0).alias("rare"),
        (F.col("id") % 7).alias("other"),
        F.when(F.col("id") % 1000 == 0, 1).otherwise(0).alias("Target1"),
    )
    params = dict(numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all")
    model = t.train_model(
        rows, t.forest(**params), features=("rare", "other"), exact_bins=8
    )
    wrong = t.predict_classes(model, rows).where("label <> prediction")
    assert wrong.count() == 0
    whole = t.score(model, rows).agg(F.sum("churn_probability")).first()[0]
    batched = t.score_in_batches(model, rows).agg(F.sum("churn_probability")).first()[0]
    assert whole == pytest.approx(40) and batched == pytest.approx(40)


def test_category_vectors_are_the_wide_columns(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice(["a", "b.c", "", None, "ü"])) for _ in range(200)]
    rows.append((9, None))
    df = spark.createDataFrame(rows, "team_id long, plan string")
    places = b.numbered_categories(df, "plan")
    order = {r.plan: r.place for r in places.collect()}
    assert sorted(order.values()) == [0, 1, 2, 3]
    got = {r.team_id: r.plans for r in b.category_vectors(df, "team_id", "plan", places, "plans").collect()}
    assert got.keys() == {1, 2, 3, None, 9}
    for team, vector in got.items():
        assert vector.size == 4
        for plan, place in order.items():
            assert vector[place] == sum(r == (team, plan) for r in rows)


def test_many_categories(spark):
    n = 100_000
    df = spark.range(3 * n).select(
        (F.col("id") % 1000).alias("team_id"), F.concat(F.lit("plan"), F.col("id") % n).alias("plan")
    )
    places = b.numbered_categories(df, "plan")
    top = places.agg(F.count("*"), F.max("place"), F.count_distinct("place")).first()
    assert tuple(top) == (n, n - 1, n)
    vectors = b.category_vectors(df, "team_id", "plan", places)
    first = vectors.where("team_id = 5").first().categories
    assert first.size == n and len(first.indices) == 100 and set(first.values) == {3.0}
    assert b.numbered_categories(df.limit(0), "plan").count() == 0
