"""Results kept in the shared folder, so that lost executors cost no rerun."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of :func:`written` lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else one in the warehouse.

    Both are places that the driver and all executors share. The rule is the same
    for every kind of session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tenuro"
    return folder.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else writes to."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(
        target, True
    )


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and broadcasts that nothing refers to any more.

    It does so whenever the driver collects its garbage, which may be long after a step has
    ended. Worth a call between the steps of a job that takes many.
    """
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this session wrote to the shared folder.

    Frames that still read from it fail afterwards, so call it at the end of a job.
    """
    remove(spark, _session_folder(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Rows keep their partitions and their order, which training relies on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_session_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str = "table", tasks: int | None = None) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder, and read it from there.

    Unlike :func:`materialise` it reads back only the columns that are used, and
    promises nothing about the order of rows. The last step has ``tasks`` at most, for what
    is known to be small: a file takes longer to open and commit than thousands of rows.
    """
    path = scratch_path(df.sparkSession, name)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`; frames that read them fail from then on."""
    for table in tables:
        remove(table.sparkSession, _PATHS.pop(table))


@contextmanager
def kept(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """Like :func:`written`, for the length of a ``with`` block; then it is deleted."""
    path = scratch_path(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)
