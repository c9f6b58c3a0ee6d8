"""How the operators run a function over the texts of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Takes texts (and the values of further columns), gives a list for each new column.
Measure = Callable[..., Sequence[Sequence]]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def crc32_of(column: str) -> Column:
    """CRC-32 of a column as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def releasing(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which Arrow gives back what it holds; workers outlive their tasks."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return released


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: str,
    prepare: Callable[[], Measure],
    chunk_chars: int = 4_000_000,
    with_columns: Sequence[str] = (),
) -> DataFrame:
    """Columns ``keep`` of ``df`` and, for each text, the values of ``fields``.

    ``prepare`` runs once for each task; what it returns sees a list of whole texts
    at a time, a null as the empty text, and a list for each of ``with_columns``. A list
    ends at ``chunk_chars`` characters, so memory follows the longest text rather than
    the batch.
    """
    added = StructType.fromDDL(fields)
    schema = StructType([df.schema[k] for k in keep] + added.fields)
    arrow = to_arrow_schema(schema)
    kept, further = list(keep), list(with_columns)
    types = [arrow.field(f.name).type for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = prepare()
        for batch in batches:
            for part in slices(batch, text, chunk_chars):
                texts = [t or "" for t in part.column(text).to_pylist()]
                values = measure(texts, *(part.column(c).to_pylist() for c in further))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in kept]
                    + [pa.array(v, t) for v, t in zip(values, types, strict=True)],
                    names=arrow.names,
                )

    return df.select(*dict.fromkeys([*kept, text, *further])).mapInArrow(releasing(run), schema)


def slices(
    batch: pa.RecordBatch, text: str, chunk_chars: int
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``chunk_chars`` bytes of text, one text at least."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > chunk_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
