"""Exact split points for trees, and sparse vectors of plans.

Spark looks for split points in a sample of the rows. Here they come from all of them:
every distinct value is a bin of its own where there are few enough, and else bins hold
equal numbers of rows as nearly as values that repeat allow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.feature import Bucketizer, SQLTransformer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window, functions as F

from tenuro.functions.categories import category_counts
from tenuro.functions.columns import column

#: Ranges in which values of a feature are put in order at a time.
RANGES = 256


def borders(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Between which values each feature is split: up to ``bins`` - 1 places, in order.

    A place is the middle of two neighbouring values. A value belongs to bin
    ``floor(bins * before / rows)``, where ``before`` rows have a lesser one, or is a bin of
    its own if there are up to ``bins`` values. Nulls and NaN count nowhere.

    Rows are counted by value first, with partial sums. Values are put in order within
    ranges, between approximate quantiles, and the counts of the ranges before are added, so
    that no task orders all values of a feature. Only the borders come to the driver.
    """
    if bins < 2:
        raise ValueError("at least two bins are needed")
    doubles = [column(f).cast("double").alias(f) for f in features]
    long = df.select(*doubles).unpivot([], list(features), "feature", "value")
    counted = (
        long.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )
    shares = [i / RANGES for i in range(1, RANGES)]
    # One row for each feature.
    figures = counted.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("values"),
        F.array_distinct(F.percentile_approx("value", shares)).alias("marks"),
    )
    ranged = counted.join(F.broadcast(figures), "feature").withColumn(
        "range", F.size(F.filter("marks", lambda m: m < F.col("value")))
    )
    in_range = Window.partitionBy("feature", "range").orderBy("value")
    earlier = Window.partitionBy("feature").orderBy("range")
    totals = ranged.groupBy("feature", "range").agg(
        F.sum("n").alias("of_range"), F.count("*").alias("values_of_range")
    )
    # Up to RANGES rows of a feature meet in this window.
    offsets = totals.select(
        "feature",
        "range",
        (F.sum("of_range").over(earlier) - F.col("of_range")).alias("before"),
        (F.sum("values_of_range").over(earlier) - F.col("values_of_range")).alias("rank"),
    )
    placed = ranged.join(offsets, ["feature", "range"]).select(
        "feature",
        "value",
        F.when(
            F.col("values") <= bins, F.col("rank") + F.row_number().over(in_range) - 1
        )
        .otherwise(
            F.floor(
                bins * (F.col("before") + F.sum("n").over(in_range) - F.col("n")) / F.col("rows")
            )
        )
        .alias("bin"),
    )
    # Up to ``bins`` rows of a feature are left.
    ends = placed.groupBy("feature", "bin").agg(
        F.min("value").alias("least"), F.max("value").alias("most")
    )
    after = F.lead("least").over(Window.partitionBy("feature").orderBy("bin"))
    rows = ends.select("feature", "most", after.alias("next")).where("next IS NOT NULL").collect()
    found: dict[str, list[float]] = {f: [] for f in features}
    for row in rows:
        found[row.feature].append(_between(row.most, row.next))
    return {f: sorted(places) for f, places in found.items()}


def _between(low: float, high: float) -> float:
    middle = low + (high - low) / 2
    return middle if low < middle <= high else high


def bin_stages(
    df: DataFrame, features: Sequence[str], bins: int = 32
) -> tuple[list[Transformer], list[str]]:
    """Stages that turn each feature into the number of its bin, and the columns they make.

    Where a null or NaN occurs, transforming raises.
    """
    # A feature of one value is never split; a border anywhere makes it a valid one.
    places = {f: found or [0.0] for f, found in borders(df, features, bins).items()}
    named = [f"_category_{i}" for i in range(len(features))]
    numbers = [f"_bin_{i}" for i in range(len(features))]
    into_bins = Bucketizer(
        splitsArray=[[-math.inf, *places[f], math.inf] for f in features],
        inputCols=list(features),
        outputCols=named,
        handleInvalid="error",
    )
    # Bins are marked as categories without an order; a sum isn't.
    sums = ", ".join(f"{c} + 0D AS {n}" for c, n in zip(named, numbers))
    ordered = SQLTransformer(statement=f"SELECT *, {sums} FROM __THIS__")
    return [into_bins, ordered], numbers


# ---------------------------------------------------------------- many plans


def numbered_categories(df: DataFrame, name: str) -> DataFrame:
    """(``name``, ``place``): the distinct non-null values, numbered from 0 in some order.

    Values are numbered within hash ranges, and the counts of the ranges before are added:
    no list of them is ever in one place, and the numbers have no gaps.
    """
    ranges = 4096
    values = df.where(column(name).isNotNull()).select(column(name).alias("value")).distinct()
    hashed = values.withColumn("range", F.pmod(F.xxhash64("value"), F.lit(ranges)))
    within = F.row_number().over(Window.partitionBy("range").orderBy("value"))
    sizes = hashed.groupBy("range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("range")) - F.col("size")  # of 4096 rows
    offsets = sizes.select("range", before.alias("before"))
    return (
        hashed.withColumn("within", within)
        .join(offsets, "range")
        .select(F.col("value").alias(name), (F.col("before") + F.col("within") - 1).alias("place"))
    )


def category_vectors(
    df: DataFrame, key: str, name: str, places: DataFrame, output: str = "categories"
) -> DataFrame:
    """(``key``, ``output``): how often each category occurs with a key, as sparse vectors.

    The same figures as one-hot columns summed by ``key``, for categories too many to be
    columns; ``places`` comes from :func:`numbered_categories`. A key without a category has
    a vector of zeros; a category that isn't in ``places`` counts nowhere.
    """
    size = places.count()

    def vector(found: list) -> SparseVector:
        return SparseVector(size, [p for p, _ in found], [float(n) for _, n in found])

    counted = category_counts(df, key, name).join(places, name)
    pairs = counted.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", "n"))).alias("found")
    )
    keys = df.select(key).distinct()
    same = F.col(f"k.{key}").eqNullSafe(F.col(f"p.{key}"))
    all_keys = keys.alias("k").join(pairs.alias("p"), same, "left").select(f"k.{key}", "p.found")
    found = F.coalesce("found", F.array().cast("array<struct<place:bigint,n:bigint>>"))
    return all_keys.select(key, F.udf(vector, VectorUDT())(found).alias(output))
