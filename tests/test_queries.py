"""Every named query against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entries
from hearthline.plans import oracle, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = registry.QUERIES, oracle.sql()
# Queries for which SQL is too slow or says nothing; unit tests compare these with brute force.
WITHOUT_SQL = {"price_scoring", "doc_chunks_recursive"}
# The only queries that run Python in their tasks.
WITH_PYTHON = {"doc_chunks_recursive"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple("null" if v is None else repr(v) for v in row) for row in zip(*columns))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    made = frame.toArrow()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # No exact percentile that would hold a group in one task.
    assert "percentile(" not in plan and "median(" not in plan
    assert ("InPandas" in plan or "ArrowEval" in plan) == (name in WITH_PYTHON)
    if name in WITHOUT_SQL:
        assert made.num_rows > 0
        return
    wanted = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(made.column_names) == sorted(wanted.column_names)
    assert [made.schema.field(c).type for c in sorted(made.column_names)] == [
        wanted.schema.field(c).type for c in sorted(made.column_names)
    ]
    assert rows(made) == rows(wanted)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entries.entry(spark).count() > 0


def test_month_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from hearthline.plans.tables import sales

    rows = sales(spark, SF, "month", "resale_price")
    plan = rows.where(F.col("month") == rows.agg(F.max("month")).scalar())._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(month" in plan and "ReadSchema: struct<month:date,resale_price:double>" in plan
