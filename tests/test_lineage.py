"""Kept results go to the folder the session names."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenuro.functions.lineage import (
    clear_scratch,
    discard,
    materialise,
    release,
    scratch_path,
    shared_folder,
    written,
)


class Session:
    """A session of which only the folder settings matter."""

    applicationId = "app-1"

    def __init__(self, folder=None):
        self.settings = {"spark.sql.warehouse.dir": "/shared/warehouse/"}
        self.settings |= {"spark.checkpoint.dir": folder} if folder else {}
        self.conf = self.sparkContext = self

    def get(self, key, *default):
        return self.settings.get(key, *default)


def test_the_session_names_the_folder():
    session = Session("/some/shared/folder/")
    assert shared_folder(session) == "/some/shared/folder"
    first, second = scratch_path(session, "x"), scratch_path(session, "x")
    assert first.startswith("/some/shared/folder/scratch-app-1/x-") and first != second


def test_without_a_folder_the_warehouse_is_used():
    assert shared_folder(Session()) == "/shared/warehouse/tenuro"


def test_materialised_rows_no_longer_depend_on_their_source(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    kept = materialise(spark.read.parquet(path))
    spark.range(3).write.mode("overwrite").parquet(path)
    assert kept.count() == 5
    kept.explain()
    plan = capsys.readouterr().out
    assert "parquet" not in plan and "Scan ExistingRDD" in plan


def test_written_rows_are_pruned_and_can_be_cleared(spark, capsys):
    kept = written(spark.range(5).select("id", F.lit("x").alias("other")))
    kept.select("id").explain()
    assert "ReadSchema: struct<id:bigint>" in capsys.readouterr().out
    assert kept.count() == 5
    folder = Path(kept.inputFiles()[0].removeprefix("file:")).parents[1]
    assert folder.exists()
    clear_scratch(spark)
    assert not folder.exists()


def test_tables_are_discarded_one_by_one(spark):
    first, second = written(spark.range(5), "first"), written(spark.range(6), "second")
    folder = Path(first.inputFiles()[0].removeprefix("file:")).parent
    discard(first)
    release(spark)
    assert not folder.exists() and second.count() == 6
    with pytest.raises(KeyError):
        discard(first)  # is no table any more
    with pytest.raises(KeyError):
        discard(second.select("id"))  # was never one
    discard(second, written(spark.range(0)))


def test_an_empty_table_can_be_written(spark):
    kept = written(spark.createDataFrame([], "a int"))
    assert kept.count() == 0 and kept.columns == ["a"]
