"""Train/test split and cross-validation folds, decided by a hash of the team.

The hash depends on the team and the seed alone, so a split comes out the same
wherever it is derived again and however the rows are partitioned.

``with_split`` and ``with_folds`` read nothing but the row itself. Their shares
are met on average. ``exact_split`` and ``stratified_folds`` meet them to the
row by ranking all rows in hash order. The rank needs no sort of the whole
table: hashes are cut into a fixed number of ranges, rows are numbered within
their range, and the row counts of the earlier ranges are added. Both read ``df``
twice, so hand them a materialised one.

No row is lost: rows without a key count as one more team, and rows without a label
as one more label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tenuro.functions.columns import columns
from tenuro.functions.hashing import HASH_RANGE, key_hash
from tenuro.schema import TEAM

#: So many tasks at most number rows at a time.
N_RANGES = 4096


def with_split(
    df: DataFrame, test_size: float = 0.25, seed: int = 0, key: str = TEAM
) -> DataFrame:
    """Add ``is_train``: false for about ``test_size`` of the teams."""
    return df.withColumn(
        "is_train", key_hash(key, f"split:{seed}") >= int(test_size * HASH_RANGE)
    )


def with_folds(
    df: DataFrame, folds: int = 3, seed: int = 0, key: str = TEAM
) -> DataFrame:
    """Add ``fold``, a number in 0..folds-1."""
    return df.withColumn(
        "fold", (key_hash(key, f"fold:{seed}") % folds).cast("int")
    )


def training_rows(df: DataFrame) -> DataFrame:
    return df.where("is_train")


def holdout_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_train"))


def exact_split(
    df: DataFrame,
    test_size: float = 0.25,
    seed: int = 0,
    key: str = TEAM,
    ranges: int = N_RANGES,
) -> DataFrame:
    """Add ``is_train``: false for exactly ``ceil(test_size * n)`` of n rows.

    ``ranges`` changes the number of tasks that rank rows, never the result.
    """
    ranked = _hash_ranked(df, key, f"split:{seed}", [], ranges)
    in_test = F.col("_rank") <= F.ceil(F.lit(float(test_size)) * F.col("_total"))
    return ranked.select(*columns(df), (~in_test).alias("is_train"))


def stratified_folds(
    df: DataFrame,
    label_col: str = "Target1",
    folds: int = 3,
    seed: int = 0,
    key: str = TEAM,
    ranges: int = N_RANGES,
) -> DataFrame:
    """Add ``fold``; each label is spread over the folds to within one row."""
    ranked = _hash_ranked(df, key, f"fold:{seed}", [label_col], ranges)
    fold = ((F.col("_rank") - 1) % folds).cast("int")
    return ranked.select(*columns(df), fold.alias("fold"))


def _hash_ranked(
    df: DataFrame, key: str, salt: str, by: list[str], n_ranges: int
) -> DataFrame:
    """Add the rank of each row in hash order, per value of ``by``, and the total."""
    # Structs with the same missing fields are equal, so a missing label is one more.
    together = ["_by"] if by else []
    hashed = df.withColumns(
        {"_hash": key_hash(key, salt), **{name: F.struct(*by) for name in together}}
    ).withColumn("_range", F.floor(F.col("_hash") * n_ranges / HASH_RANGE))
    ranges = hashed.groupBy(*together, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``n_ranges`` rows per value of ``by``, whatever the size of ``df``.
    group = W.partitionBy(*together)
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        *together,
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )
    in_range = W.partitionBy(*together, "_range").orderBy("_hash", key)
    # The window has distributed the rows the way the join wants them.
    return (
        hashed.withColumn("_place", F.row_number().over(in_range))
        .join(offsets, [*together, "_range"])
        .withColumn("_rank", F.col("_before") + F.col("_place"))
    )
