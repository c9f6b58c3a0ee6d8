"""A sparse ensemble of rules that tells good texts from bad ones.

Statistics of each text are Spark expressions. A small forest is fitted on them, and the
path to each of its nodes is a rule: a conjunction of bounds on statistics. A lasso
logistic regression weighs the rules and leaves few of them. Those become one Spark
column, so scoring needs no model at run time and no Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenuro.functions.lineage import written
from tenuro.llm.common import crc32_of, table

#: Partitions of the rows that are fitted on, whose number is bounded.
PARTITIONS = 8
#: Statistics of a text; ``text``, ``words`` and ``lines`` are at hand, never null.
_COUNTS = {
    "n_chars": "char_length(text)",
    "n_words": "size(words)",
    "n_lines": "size(lines)",
    "distinct_words": "size(array_distinct(words))",
    "distinct_lines": "size(array_distinct(lines))",
    "word_chars": "char_length(text) - char_length(regexp_replace(text, '\\\\S+', ''))",
    "upper": "char_length(text) - char_length(regexp_replace(text, '\\\\p{Lu}+', ''))",
    "letters": "char_length(text) - char_length(regexp_replace(text, '\\\\p{L}+', ''))",
    "digits": "char_length(text) - char_length(regexp_replace(text, '[0-9]+', ''))",
    "symbols": "char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>~^_=+{}]+', ''))",
    "marks": "char_length(text) - char_length(regexp_replace(text, '[!?]+', ''))",
    "stops": "char_length(text) - char_length(regexp_replace(text, '[.,;:]+', ''))",
}
STATISTICS = {
    "log_words": "ln(1 + n_words)",
    "log_lines": "ln(1 + n_lines)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "distinct_word_share": "distinct_words / greatest(n_words, 1)",
    "distinct_word_power": "ln(1 + distinct_words) / ln(2 + n_words)",
    "distinct_line_share": "distinct_lines / greatest(n_lines, 1)",
    "upper_share": "upper / greatest(letters, 1)",
    "letter_share": "letters / greatest(word_chars, 1)",
    "digit_share": "digits / greatest(word_chars, 1)",
    "symbol_share": "symbols / greatest(word_chars, 1)",
    "symbols_a_word": "symbols / greatest(n_words, 1)",
    "marks_a_word": "marks / greatest(n_words, 1)",
    "stops_a_word": "stops / greatest(n_words, 1)",
}


def statistics(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` and ``stats``, a struct of the statistics, for every row.

    A null counts as the empty text, of which all statistics are 0 but the shares of
    distinct words and lines. Columns of ``df`` not in ``keep`` are left aside.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    raw = df.select(
        *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), value.alias("text")
    ).withColumns(
        {
            "words": F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)),
            "lines": F.split("text", "\n"),
        }
    )
    counted = raw.select(
        *(f"keep_{i}" for i in range(len(keep))),
        *(F.expr(e).alias(name) for name, e in _COUNTS.items()),
    )
    return counted.select(
        *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)),
        F.struct(
            *(F.expr(e).cast("double").alias(name) for name, e in STATISTICS.items())
        ).alias("stats"),
    )


# ---------------------------------------------------------------- rules

#: A bound on a statistic: its name, whether the bound is an upper one, and the bound.
Bound = tuple[str, bool, float]


@dataclass(frozen=True)
class Rule:
    """All of ``bounds`` hold: at most the bound if it is an upper one, else more."""

    bounds: frozenset[Bound]

    def column(self, stats: str = "stats") -> Column:
        holds = F.lit(True)
        for name, upper, bound in sorted(self.bounds):
            value = F.col(f"{stats}.{name}")
            holds &= value <= bound if upper else value > bound
        return holds


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; the score is the logistic function of their sum."""

    intercept: float
    weights: dict[Rule, float]

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total += F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


_BOUND = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")


def rules_of_trees(description: str, names: Sequence[str]) -> list[Rule]:
    """The path to every node but the roots, from the text that Spark gives of a forest.

    Of several bounds of a path on one side of a statistic the tightest stays.
    """
    rules: dict[Rule, None] = {}
    path: list[tuple[int, Bound]] = []
    for line in description.splitlines():
        match = _BOUND.search(line)
        if match is None:
            continue
        depth = len(line) - len(line.lstrip())
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (names[int(match[2])], match[3] == "<=", float(match[4]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, upper, bound) in path:
            known = tightest.get((name, upper), bound)
            tightest[name, upper] = min(known, bound) if upper else max(known, bound)
        rules[Rule(frozenset((n, u, b) for (n, u), b in tightest.items()))] = None
    return list(rules)


def fit_rule_ensemble(
    labelled: DataFrame,
    label: str = "label",
    trees: int = 20,
    depth: int = 3,
    penalty: float = 0.001,
    max_training_rows: int = 50_000,
    seed: int = 7,
) -> RuleEnsemble:
    """Fit on rows with ``stats`` and a 0/1 ``label``; other labels and nulls are left out.

    Rows with the same statistics and label are one row, of a weight that counts them. The
    fit uses a sample of about ``max_training_rows`` of those, chosen by a hash of what they
    hold, so that the same rows give the same model in any order. With one class only, or none, there is nothing to tell apart: the score
    is the share of ones, a half without any rows.
    """
    names = list(STATISTICS)
    rows = written(
        labelled.where(F.col(label).isin(0, 1))
        .groupBy("stats", F.col(label).cast("double").alias("label"))
        .agg(F.count("*").cast("double").alias("weight")),
        "training-rows",
    )
    share = F.sum(F.col("weight") * F.col("label")) / F.sum("weight")
    counts = rows.agg(F.count("*").alias("n"), share.alias("share")).first()
    if not counts.n or counts.share in (0.0, 1.0):
        # Not quite 0 or 1, so that the logarithm exists.
        share = 0.5 if not counts.n else min(max(counts.share, 1e-6), 1 - 1e-6)
        return RuleEnsemble(math.log(share / (1 - share)), {})
    if counts.n > max_training_rows:
        place = F.pmod(F.xxhash64("stats", "label"), F.lit(1 << 30))
        rows = rows.where(place < int((1 << 30) * max_training_rows / counts.n))
    # Samples of trees are drawn by position, so rows have a fixed one.
    rows = rows.repartition(PARTITIONS, "stats", "label").sortWithinPartitions("stats", "label")
    flat = rows.select("label", "weight", *(F.col(f"stats.{n}").alias(n) for n in names))
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, minInstancesPerNode=5,
        featureSubsetStrategy="onethird", seed=seed, weightCol="weight",
    ).fit(assembler.transform(flat))
    rules = rules_of_trees(forest.toDebugString, names)
    if not rules:
        return RuleEnsemble(math.log(counts.share / (1 - counts.share)), {})
    matrix = rows.select(
        "label",
        "weight",
        array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"),
    )
    # Every step of the descent is a job over all partitions, and rows are bounded: where a
    # session deals them out to more, a task takes several.
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=100, weightCol="weight"
    ).fit(matrix.coalesce(PARTITIONS))
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients) if w}
    return RuleEnsemble(float(lasso.intercept), weights)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labels that aren't held out.

    Statistics are computed once and written; the fit and the scores both read them. A
    document that is repeated or has repeated labels counts as often for the fit.
    """
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = crc32_of("doc_id") % 5 == 0
    measured = written(statistics(documents), "statistics")
    training = measured.join(labels.where(~held_out), "doc_id").withColumnRenamed(
        "quality", "label"
    )
    score = fit_rule_ensemble(training).score()
    return measured.select(
        "doc_id", held_out.alias("held_out"), score.alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
