"""Quality rules with a ledger: one bit for each rule that a text fails.

Every rule is evaluated once. The ledger keeps the measurements and the failure
bits, so that a policy, which is a set of rules with a version, is a mask over
those bits, and what each rule costs is counted from the bits alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenuro.llm.common import map_texts, table

MEASUREMENTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_lines long, n_upper long, n_letters long"
)
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower()


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    if size == n:
        return 0
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:  # keep the products within 63 bits
        distinct, pairs = np.unique(pairs, return_inverse=True)
        if len(distinct) >= 1 << 31:
            raise ValueError("a text of over 2**31 words")
    windows = pairs[:-1] * size + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = counts[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= repeated
    return int(covered.sum())


def measure(texts: list[str]) -> list[list[int]]:
    """The measurements of whole texts; words end at ASCII white space only."""
    rows = []
    for text in texts:
        data = text.encode()
        words = data.split()
        lines = [line for line in data.split(b"\n") if line.strip()]
        rows.append(
            (
                len(words),
                len(text) - (len(data) - sum(map(len, words))),
                len(data) - len(data.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)),
                repeated_words(words),
                len(lines),
                len(data) - len(data.translate(None, _UPPER)),
                len(data) - len(data.translate(None, _LETTERS)),
            )
        )
    return [list(column) for column in zip(*rows, strict=True)]


#: A rule's name and the condition under which a text fails it, in the order of the
#: bits. Rules are only ever added at the end, so that stored bits keep their meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "100 * n_upper > 40 * n_letters",
    "no_letters": "n_letters = 0",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """The rules that a version of the filter enforces."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Mapping[str, str] = RULES) -> int:
        names = list(rules)
        return sum(1 << names.index(rule) for rule in set(self.rules))


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", (*BASE, "symbols", "repeated_lines", "capitals")),
    "v2": Policy(
        "v2",
        (*BASE, "symbols", "repeated_lines", "capitals", "short_words", "long_words"),
    ),
}


def failure_bits(rules: Mapping[str, str] = RULES) -> Column:
    """Bit i is set where rule i fails; a condition that is null doesn't fail."""
    if len(rules) > 63:
        raise ValueError("a ledger has room for 63 rules")
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        failed = F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0))
        bits = bits.bitwiseOR(failed.cast("long"))
    return bits


def ledger(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    rules: Mapping[str, str] = RULES,
) -> DataFrame:
    """Columns ``keep``, the measurements and ``failures``, for every row of ``df``.

    One row each, also for repeated rows. A null or empty text measures 0 throughout
    and fails ``few_words``. Other columns of ``df`` are left aside, whatever their
    names, but a column in ``keep`` may not be called like a measurement.
    """
    measured = map_texts(df, text, keep, MEASUREMENTS, lambda: measure)
    return measured.withColumn("failures", failure_bits(rules))


def apply_policy(
    ledger_rows: DataFrame, policy: Policy, rules: Mapping[str, str] = RULES
) -> DataFrame:
    """The ledger with ``kept`` under a policy; no text is read again."""
    failed = F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))
    return ledger_rows.withColumns(
        {"kept": failed == 0, "policy": F.lit(policy.version)}
    )


def ablations(
    ledger_rows: DataFrame, policy: Policy, rules: Mapping[str, str] = RULES
) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that fail it alone.

    ``n_alone`` is what dropping the rule would bring back. Rows are first counted by
    their bits, of which there are few, so the hot value of the bits is no burden. An
    empty ledger gives one row a rule, with zeros.
    """
    mask = F.lit(policy.mask(rules)).cast("long")
    combined = (
        ledger_rows.select(F.col("failures").bitwiseAND(mask).alias("bits"))
        .groupBy("bits")
        .agg(F.count("*").alias("n"))
    )
    names = list(rules)
    chosen = [(r, 1 << names.index(r)) for r in dict.fromkeys(policy.rules)]
    zero = F.lit(0).cast("long")
    counts = combined.agg(
        F.array(
            *(
                F.struct(
                    F.lit(policy.version).alias("policy"),
                    F.lit(rule).alias("rule"),
                    F.coalesce(
                        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n"))),
                        zero,
                    ).alias("n_failed"),
                    F.coalesce(
                        F.sum(F.when(F.col("bits") == bit, F.col("n"))), zero
                    ).alias("n_alone"),
                )
                for rule, bit in chosen
            )
        ).alias("rules")
    )
    return counts.select(F.inline("rules"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, judged by the newest policy."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = apply_policy(ledger(documents), POLICIES["v2"])
    base = F.lit(POLICIES["base"].mask()).cast("long")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failures").bitwiseAND(base) != 0).alias("base_failed"),
        "kept",
        "failures",
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT rid, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM d
), w AS (
  SELECT rid, i, [words[i], words[i + 1], words[i + 2]] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM t)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM w)
  WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM rep, (VALUES (0), (1), (2)) AS shifts(k) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT)
           AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, n_upper, n_letters
  FROM t LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1,
         100 * n_symbols > 20 * n_words AS f2, 100 * n_dup_lines > 30 * n_lines AS f3,
         word_chars < 2 * n_words AS f4, word_chars > 20 * n_words AS f5,
         100 * n_upper > 40 * n_letters AS f6, n_letters = 0 AS f7
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       f0 OR f1 AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
       CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT
            + 32 * f5::INT + 64 * f6::INT + 128 * f7::INT AS BIGINT) AS failures
FROM f
"""
