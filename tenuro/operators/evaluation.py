"""Tables that compare a predicted class with the true one.

Both start from one global aggregation that counts every (label, prediction)
pair, so what is moved between tasks is one row of counts each. A row whose label
or prediction is missing or not among ``classes`` raises rather than vanish.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F


def confusion_matrix(
    df: DataFrame,
    label_col: str = "label",
    prediction_col: str = "prediction",
    classes: Sequence[int] = (0, 1),
) -> DataFrame:
    """One row per true class, one column ``predicted_<class>`` per prediction."""
    counts = _pair_counts(df, label_col, prediction_col, classes)
    return counts.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(true).alias("label"),
                        *(
                            _cell(true, guess).alias(f"predicted_{guess}")
                            for guess in classes
                        ),
                    )
                    for true in classes
                )
            )
        )
    )


def classification_report(
    df: DataFrame,
    label_col: str = "label",
    prediction_col: str = "prediction",
    classes: Sequence[int] = (0, 1),
    swap_axes: bool = False,
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and averages.

    The accuracy stands in the F1 column of its own row. A ratio with nothing
    below the line is 0. ``swap_axes`` takes the prediction for the truth and
    the truth for the prediction.
    """
    if swap_axes:
        label_col, prediction_col = prediction_col, label_col
    counts = _pair_counts(df, label_col, prediction_col, classes)

    def per_class(c: int) -> Column:
        hits = _cell(c, c)
        support = _total(_cell(c, guess) for guess in classes)
        guessed = _total(_cell(true, c) for true in classes)
        return F.struct(
            F.lit(str(c)).alias("class"),
            _ratio(hits, guessed).alias("precision"),
            _ratio(hits, support).alias("recall"),
            _ratio(2 * hits, support + guessed).alias("f1_score"),
            support.alias("support"),
        )

    measured = counts.select(
        F.array(*map(per_class, classes)).alias("classes"),
        _total(_cell(c, c) for c in classes).alias("hits"),
        _total(_cell(t, g) for t in classes for g in classes).alias("rows"),
    )

    def average(name: str, weight) -> Column:
        scores = (
            _ratio(
                _total(
                    F.col("classes")[i][score] * weight(i) for i in range(len(classes))
                ),
                _total(weight(i) for i in range(len(classes))),
            ).alias(score)
            for score in ("precision", "recall", "f1_score")
        )
        return F.struct(F.lit(name).alias("class"), *scores, F.col("rows").alias("support"))

    accuracy = F.struct(
        F.lit("accuracy").alias("class"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        _ratio(F.col("hits"), F.col("rows")).alias("f1_score"),
        F.col("rows").alias("support"),
    )
    macro = average("macro avg", lambda i: F.lit(1.0))
    weighted = average("weighted avg", lambda i: F.col("classes")[i]["support"])
    return measured.select(
        F.inline(F.concat("classes", F.array(accuracy, macro, weighted)))
    )


def _pair_counts(
    df: DataFrame, label_col: str, prediction_col: str, classes: Sequence[int]
) -> DataFrame:
    names = [f"n_{true}_{guess}" for true in classes for guess in classes]
    counts = df.agg(
        *(
            F.count_if(
                (F.col(label_col) == true) & (F.col(prediction_col) == guess)
            ).alias(f"n_{true}_{guess}")
            for true in classes
            for guess in classes
        ),
        F.count(F.lit(1)).alias("_rows"),
    )
    listed = ", ".join(map(str, classes))
    other = F.raise_error(
        F.lit(f"{label_col} or {prediction_col} has values other than {listed}")
    ).cast("bigint")
    complete = _total(map(F.col, names)) == F.col("_rows")
    return counts.select(
        *(F.when(complete, F.col(n)).otherwise(other).alias(n) for n in names)
    )


def _cell(true: int, guess: int) -> Column:
    return F.col(f"n_{true}_{guess}")


def _total(columns) -> Column:
    return reduce(add, columns)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
