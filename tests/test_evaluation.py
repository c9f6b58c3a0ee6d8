"""Confusion matrix and classification report against brute force."""

import random
from statistics import fmean

import pytest
from pyspark.errors import PySparkException

import tenuro as t
from tests.tables import rows_of


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int")


def expected_report(rows, classes):
    report, support = {}, {}
    for c in classes:
        hits = sum(a == b == c for a, b in rows)
        guessed = sum(b == c for _, b in rows)
        support[c] = sum(a == c for a, _ in rows)
        precision = hits / guessed if guessed else 0.0
        recall = hits / support[c] if support[c] else 0.0
        both = precision + recall
        f1 = 2 * precision * recall / both if both else 0.0
        report[str(c)] = (precision, recall, f1, support[c])
    n = len(rows)
    scores = [report[str(c)][:3] for c in classes]
    weights = [support[c] for c in classes]
    accuracy = sum(a == b for a, b in rows) / n if n else 0.0
    report["accuracy"] = (None, None, accuracy, n)
    report["macro avg"] = (*map(fmean, zip(*scores)), n)
    report["weighted avg"] = (
        *(
            sum(s * w for s, w in zip(column, weights)) / n if n else 0.0
            for column in zip(*scores)
        ),
        n,
    )
    return report


def check(df, expected):
    actual = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert actual.keys() == expected.keys()
    for name, values in expected.items():
        assert actual[name] == pytest.approx(values), name


CASES = {
    "mixed": [(random.Random(i).randrange(2), i % 3 % 2) for i in range(100)],
    "never 1 predicted": [(0, 0), (1, 0), (1, 0)],
    "only one class": [(1, 1), (1, 1)],
    "all wrong": [(0, 1), (1, 0)],
    "empty": [],
}


@pytest.mark.parametrize("rows", CASES.values(), ids=CASES.keys())
def test_two_classes(spark, rows):
    df = pairs(spark, rows)
    matrix = t.confusion_matrix(df)
    assert rows_of(matrix) == [
        (a, *(sum(r == (a, b) for r in rows) for b in (0, 1))) for a in (0, 1)
    ]
    check(t.classification_report(df), expected_report(rows, (0, 1)))
    check(
        t.classification_report(df, swap_axes=True),
        expected_report([(b, a) for a, b in rows], (0, 1)),
    )


def test_three_classes(spark):
    rows = [(i % 3, i * i % 5 % 3) for i in range(50)]
    report = t.classification_report(pairs(spark, rows), classes=(0, 1, 2))
    check(report, expected_report(rows, (0, 1, 2)))


@pytest.mark.parametrize("row", [(2, 0), (0, 2), (None, 1), (1, None)])
@pytest.mark.parametrize("table", [t.confusion_matrix, t.classification_report])
def test_a_row_outside_the_classes_raises(spark, row, table):
    df = pairs(spark, [(0, 0), (1, 0), row])
    with pytest.raises(PySparkException, match="label or prediction has values other"):
        table(df).collect()
