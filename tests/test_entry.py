"""Every registered query against its SQL twin, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tenuro.schema import DATASET

SF = "/root/testdata/sf0.001"
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "BOOLEAN": "boolean",
}
QUERIES, ORACLE = entry.core_queries(), entry.core_oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("orders", "lineitem"):
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'"
        )
    return connection


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_sql(spark, duck, name):
    df, relation = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    types = {c: TYPES[str(t)] for c, t in zip(relation.columns, relation.types)}
    assert dict(df.dtypes) == types
    names = sorted(types)
    at = [relation.columns.index(n) for n in names]
    expected = [tuple(r[i] for i in at) for r in relation.fetchall()]
    assert in_order(map(tuple, df.select(*names).collect())) == in_order(expected)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    flagship = entry.entry(spark)
    assert flagship.columns == list(DATASET) and flagship.count() == 135


def test_registered_searches_try_all_depths_and_shares(spark):
    tried = entry.t.param_grid(entry.t.forest(), entry.SMALL_GRID)
    shapes = {tuple(v for p, v in c.items() if p.name != "numTrees") for c in tried}
    full = entry.t.FULL_GRID
    assert shapes == {(d, f) for d in full["maxDepth"] for f in full["featureSubsetStrategy"]}
    assert len(shapes) == 30 and len(tried) == 3 * len(shapes)
