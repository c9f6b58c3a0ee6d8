"""Reading the two tables from files."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import tenuro as t
from tenuro.schema import ACTIVITY, MEASURES, NULL_TOKENS
from tests.tables import AS_OF, rows_of


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_every_null_token_reads_as_null(spark, tmp_path):
    lines = [f"{n},2020-01-01,{n},{n},{n}" for n in NULL_TOKENS if n]
    path = write(
        tmp_path / "l.csv",
        "team_id,license_start,license_end,plan,quantity",
        ',2020-01-01,"",,',
        *lines,
    )
    licenses = t.read_licenses(spark, path)
    assert licenses.count() == len(NULL_TOKENS)
    for column in ("team_id", "license_end", "plan", "quantity"):
        assert licenses.where(F.col(column).isNotNull()).count() == 0


def test_licenses_keep_other_columns_and_quoting(spark, tmp_path):
    path = write(
        tmp_path / "l.csv",
        "license_id,team_id,license_start,license_end,plan,quantity,a.note",
        '1,12.0,2020-01-01,2020-02-01,pro1, 3 ,"said ""yes"", twice"',
        "2,13.,2020-01-01,NA,edu1,,",
    )
    licenses = t.read_licenses(spark, path)
    assert dict(licenses.dtypes)["team_id"] == dict(licenses.dtypes)["quantity"] == "bigint"
    assert rows_of(licenses) == [
        ("1", 12, "2020-01-01", "2020-02-01", "pro1", 3, 'said "yes", twice'),
        ("2", 13, "2020-01-01", None, "edu1", None, None),
    ]
    prepared = t.prepare_licenses(licenses, AS_OF)
    assert "a.note" in prepared.columns and prepared.count() == 2


def test_activity_with_other_columns(spark, golden_activity):
    wider = golden_activity.select(
        "*", F.lit(None).cast("int").alias("b.n"), F.lit("x").alias("a.note")
    )
    filled = t.filled_activity(wider)
    assert rows_of(filled, "`b.n`", "`a.note`") == [(0, "x")] * 10


def test_activity_from_csv_parquet_and_memory_agree(spark, tmp_path, golden_activity):
    folder = str(tmp_path / "csv")
    golden_activity.write.csv(folder, header=True, nullValue="None")
    stored = str(tmp_path / "parquet")
    golden_activity.write.parquet(stored)
    from_csv = t.read_activity(spark, folder)
    assert from_csv.dtypes == golden_activity.dtypes
    assert rows_of(from_csv) == rows_of(golden_activity)
    assert rows_of(t.read_activity(spark, stored, "parquet")) == rows_of(from_csv)


def test_other_separators(spark, tmp_path):
    path = write(
        tmp_path / "l.csv",
        "team_id;license_start;license_end;plan;quantity",
        "1;2020-01-01;2020-02-01;pro1;2",
    )
    assert t.read_licenses(spark, path, sep=";").first().quantity == 2


def test_nan_is_null(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, nan, "2020-01-01"), (nan, 2.0, "2020-01-01")],
        "team_id double, user_id double, event_date string",
    ).select("*", *(F.lit(nan).alias(m) for m in MEASURES))
    activity = t.conform_activity(df)
    assert activity.dtypes == [(f.name, f.dataType.simpleString()) for f in ACTIVITY]
    assert rows_of(activity, "team_id", "user_id") == [(1, None), (None, 2)]


@pytest.mark.parametrize("kind", ["double", "float", "decimal(6,2)"])
def test_fractions_raise_instead_of_being_cut_off(spark, golden_licenses, kind):
    whole = golden_licenses.withColumn("quantity", F.col("quantity").cast(kind))
    assert rows_of(t.conform_licenses(whole)) == rows_of(golden_licenses)
    halves = whole.withColumn("quantity", (F.col("quantity") / 2).cast(kind))
    with pytest.raises(PySparkException, match="quantity is not a whole number"):
        t.conform_licenses(halves).collect()


def test_bad_numbers_and_missing_columns_raise(spark, tmp_path):
    path = write(
        tmp_path / "l.csv",
        "team_id,license_start,license_end,plan,quantity",
        "one,2020-01-01,2020-02-01,pro1,2",
    )
    with pytest.raises(PySparkException):
        t.read_licenses(spark, path).collect()
    with pytest.raises(ValueError, match="quantity"):
        t.conform_licenses(spark.createDataFrame([(1,)], "team_id int"))


def test_derived_tables_keep_every_row(spark):
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert t.licenses_from_orders(orders).count() == orders.count()
    assert t.activity_from_orders(orders, lineitem).count() == lineitem.count()


HEADER = "team_id,license_start,license_end,plan,quantity"


def test_whole_numbers_in_exponent_form(spark, tmp_path):
    path = write(tmp_path / "l.csv", HEADER, "1e3,,,,2.5E1", "1.2e1,,,,0e0", "7.0,,,,3")
    got = t.read_licenses(spark, path).select("team_id", "quantity")
    assert rows_of(got) == [(7, 3), (12, 0), (1000, 25)]
    path = write(tmp_path / "bad.csv", HEADER, "15e-1,,,,1")
    with pytest.raises(PySparkException, match="not a whole number"):
        t.read_licenses(spark, path).collect()


def test_a_file_with_another_header_raises(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER, "1,2020-01-01,2020-02-01,pro1,2")
    swapped = ",".join(reversed(HEADER.split(",")))
    write(tmp_path / "b.csv", swapped, "2,pro1,2020-02-01,2020-01-01,1")
    with pytest.raises((PySparkException, Py4JJavaError), match="(?i)header"):
        t.read_licenses(spark, str(tmp_path)).select("team_id", "quantity").collect()


@pytest.mark.parametrize(
    "record", ["1,2020-01-01,2020-02-01,pro1,2,7", "1,2020-01-01", '1,"2020-01-01\nx",,,']
)
def test_records_of_another_length_raise(spark, tmp_path, record):
    path = write(tmp_path / "l.csv", HEADER, "1,,,,1", record)
    for columns in ("*", "team_id"):
        with pytest.raises((PySparkException, Py4JJavaError), match="(?i)malformed"):
            t.read_licenses(spark, path).select(columns).collect()


def test_short_records_and_line_breaks_may_be_allowed(spark, tmp_path):
    path = write(tmp_path / "l.csv", HEADER, "1,2020-01-01")
    short = t.read_licenses(spark, path, mode="PERMISSIVE")
    assert rows_of(short) == [(1, "2020-01-01", None, None, None)]
    path = write(tmp_path / "m.csv", HEADER + ",note", '1,,,,2,"a\nb"')
    broken = t.read_licenses(spark, path, multiLine=True)
    assert rows_of(broken) == [(1, None, None, None, 2, "a\nb")]
