import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tenuro.llm import quality_classifier as qc
from tests.llm.conftest import SF


def test_rules_are_the_paths_of_trees():
    text = "\n".join(
        [
            "Model: uid=x, numTrees=1, numFeatures=2",
            "  Tree 0 (weight 1.0):",
            "    If (feature 0 <= 0.5)",
            "     If (feature 0 <= 0.25)",
            "      Predict: 0.0",
            "     Else (feature 0 > 0.25)",
            "      Predict: 1.0",
            "    Else (feature 0 > 0.5)",
            "     Predict: 1.0E-4",
        ]
    )
    rules = {tuple(sorted(r.bounds)) for r in qc.rules_of_trees(text, ["x", "y"])}
    assert rules == {
        (("x", True, 0.5),),
        (("x", True, 0.25),),
        (("x", False, 0.25), ("x", True, 0.5)),
        (("x", False, 0.5),),
    }


def test_scores_tell_held_out_labels(spark, documents):
    measured = qc.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality IS NOT NULL")
    rows = measured.join(labels, "doc_id").withColumn("label", F.col("quality"))
    model = qc.fit_rule_ensemble(rows.where("doc_id % 3 > 0"))
    assert 0 < len(model.weights) < 280
    test = rows.where("doc_id % 3 = 0").select("label", model.score().alias("score"))
    right = test.where((F.col("score") >= 0.3) == (F.col("label") == 1)).count()
    assert right >= 0.95 * test.count()


def plain_statistics(text):
    """Every statistic of one text, from characters and lists."""
    text = text or ""
    white = " \t\n\x0b\x0c\r"
    words = re.split(f"[{white}]+", text.strip(white)) if text.strip(white) else []
    lines = text.split("\n")
    inside = sum(map(len, words))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)

    def of(characters):
        return sum(c in characters for c in text)

    n, symbols = max(len(words), 1), of("#*$%&|<>~^_=+{}")
    return {
        "log_words": math.log(1 + len(words)),
        "log_lines": math.log(1 + len(lines)),
        "word_length": inside / n,
        "words_a_line": len(words) / len(lines),
        "distinct_word_share": len(set(words)) / n,
        "distinct_word_power": math.log(1 + len(set(words))) / math.log(2 + len(words)),
        "distinct_line_share": len(set(lines)) / len(lines),
        "upper_share": upper / max(letters, 1),
        "letter_share": letters / max(inside, 1),
        "digit_share": of("0123456789") / max(inside, 1),
        "symbol_share": symbols / max(inside, 1),
        "symbols_a_word": symbols / n,
        "marks_a_word": of("!?") / n,
        "stops_a_word": of(".,;:") / n,
    }


def plain_score(model, stats):
    total = model.intercept
    for rule, weight in model.weights.items():
        if all(stats[name] <= b if upper else stats[name] > b for name, upper, b in rule.bounds):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_statistics_and_scores_match_a_plain_version(documents, odd):
    measured = qc.statistics(documents, keep=("doc_id", "text"))
    rows = measured.withColumn("label", (F.col("stats.symbol_share") > 0.02).cast("int"))
    model = qc.fit_rule_ensemble(rows)
    assert len(model.weights) > 3
    both = measured.union(qc.statistics(odd, keep=("doc_id", "text")))
    for r in both.withColumn("score", model.score()).collect():
        expected = plain_statistics(r.text)
        assert r.stats.asDict() == pytest.approx(expected, abs=1e-12), r.doc_id
        assert r.score == pytest.approx(plain_score(model, r.stats.asDict()), abs=1e-9)


def test_the_fit_depends_on_rows_alone(documents):
    measured = qc.statistics(documents)
    rows = measured.withColumn("label", (F.col("stats.symbol_share") > 0.02).cast("int"))
    models = [
        qc.fit_rule_ensemble(df, max_training_rows=120)
        for df in (rows, rows.repartition(5), rows.orderBy(F.desc("doc_id")))
    ]
    assert models[0].weights.keys() == models[1].weights.keys() == models[2].weights.keys()
    assert models[0].intercept == pytest.approx(models[1].intercept, abs=1e-9)


def test_odd_rows_have_statistics(odd, nothing):
    rows = qc.statistics(odd).collect()
    assert len(rows) == odd.count()
    assert all(v is not None and v == v for r in rows for v in r.stats)
    assert qc.statistics(nothing).count() == 0


@pytest.mark.parametrize("labels, score", [([1, 1], 1.0), ([0, None], 0.0), ([None, 7], 0.5)])
def test_without_two_classes_the_score_is_their_share(spark, odd, labels, score):
    rows = qc.statistics(odd).limit(2).collect()
    schema = qc.statistics(odd).select("stats").schema.add("label", "integer")
    df = spark.createDataFrame([(r.stats, v) for r, v in zip(rows, labels)], schema)
    model = qc.fit_rule_ensemble(df)
    got = qc.statistics(odd).select(model.score()).first()[0]
    assert abs(got - score) < 1e-5 and model.weights == {}


def test_the_sample_is_bounded(spark):
    measured = qc.statistics(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = measured.withColumn("label", (F.col("stats.symbol_share") > 0.02).cast("int"))
    assert qc.fit_rule_ensemble(rows, max_training_rows=100).weights is not None


def test_descent_runs_over_few_partitions_however_rows_are_dealt(spark, monkeypatch):
    """Each of its steps is a job, so a session with many partitions would pay for all of them."""
    frame, estimator = type(spark.range(0)), qc.LogisticRegression
    dealt, fitted, seen = frame.repartition, estimator.fit, []

    def into_many(self, n, *columns):
        return dealt(self, max(n, 50) if columns else n, *columns)

    def fit(self, rows):
        seen.append(rows.rdd.getNumPartitions())
        return fitted(self, rows)

    rows = spark.range(400).select(
        F.struct(
            *(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(97)).cast("double").alias(n) for n in qc.STATISTICS)
        ).alias("stats"),
        F.when(F.pmod(F.xxhash64("id", F.lit("log_words")), F.lit(97)) < 40, 1).otherwise(0).alias("label"),
    )
    monkeypatch.setattr(estimator, "fit", fit)
    monkeypatch.setattr(frame, "repartition", into_many)
    model = qc.fit_rule_ensemble(rows, trees=3)
    assert seen == [qc.PARTITIONS]
    assert model.weights
