"""Train/test split and folds."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tenuro as t
from tests.tables import rows_of


def hash32(salt, key):
    return int(hashlib.md5(f"{salt}:{key}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def teams(spark):
    return spark.range(3000).select(
        F.col("id").alias("team_id"),
        (F.col("id") % 7 == 0).cast("int").alias("Target1"),
    )


def test_split_follows_the_hash(teams):
    split = t.with_split(teams, seed=3)
    expected = [(i, hash32("split:3", i) >= 2**30) for i in range(3000)]
    assert rows_of(split, "team_id", "is_train") == expected
    share = t.holdout_rows(split).count() / 3000
    assert 0.22 < share < 0.28
    assert t.holdout_rows(split).count() + t.training_rows(split).count() == 3000


@pytest.mark.parametrize(
    "operator", [t.with_split, t.with_folds, t.exact_split, t.stratified_folds]
)
def test_partitioning_does_not_matter(teams, operator):
    assert rows_of(operator(teams)) == rows_of(operator(teams.repartition(7)))


def test_seeds_differ(teams):
    first, second = (
        {r.team_id for r in t.holdout_rows(t.with_split(teams, seed=s)).collect()}
        for s in (0, 1)
    )
    assert first != second


@pytest.mark.parametrize("n", [1, 3, 10, 2999])
@pytest.mark.parametrize("test_size", [0.25, 0.1])
def test_exact_split(teams, n, test_size):
    split = t.exact_split(teams.where(F.col("team_id") < n), test_size)
    ranked = sorted(range(n), key=lambda i: (hash32("split:0", i), i))
    held_out = {r.team_id for r in t.holdout_rows(split).collect()}
    assert held_out == set(ranked[: math.ceil(test_size * n)])
    assert split.count() == n


def test_folds(teams):
    folds = t.with_folds(teams, folds=4, seed=2)
    assert rows_of(folds, "team_id", "fold") == [
        (i, hash32("fold:2", i) % 4) for i in range(3000)
    ]


def test_stratified_folds(teams):
    folds = t.stratified_folds(teams, folds=3)
    cells = Counter((r.Target1, r.fold) for r in folds.collect())
    for label, total in Counter(int(i % 7 == 0) for i in range(3000)).items():
        sizes = [cells[label, f] for f in range(3)]
        assert sum(sizes) == total and max(sizes) - min(sizes) <= 1


def test_no_row_is_lost_for_a_missing_key_or_label(spark):
    rows = [(None, 0), (None, None), (1, None), (2, 0), (2, 1), (3, 1)]
    df = spark.createDataFrame(rows, "team_id long, Target1 int")
    for split in (t.with_split(df), t.exact_split(df)):
        sides = rows_of(t.training_rows(split)) + rows_of(t.holdout_rows(split))
        assert len(sides) == len(rows)
    for folds in (t.with_folds(df), t.stratified_folds(df)):
        assert rows_of(folds.select("team_id", "Target1")) == rows_of(df)
        assert folds.where("fold IS NULL").count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_the_number_of_ranges_changes_nothing(spark, ranges):
    df = spark.range(500).select(
        F.col("id").alias("team_id"), (F.col("id") % 2).cast("int").alias("Target1")
    )
    assert rows_of(t.exact_split(df, ranges=ranges)) == rows_of(t.exact_split(df))
    assert rows_of(t.stratified_folds(df, ranges=ranges)) == rows_of(t.stratified_folds(df))
