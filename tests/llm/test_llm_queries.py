"""Every query against its SQL in another engine, and what the plans must not hold."""

import duckdb
import pytest

import __spark_entry__ as entries
from hearthline.llm import oracle, queries

SF = "/root/testdata/sf0.001"
# SQL has no tokenizer, no clustering and no training; MinHash finds by chance; its regular expressions look at nothing before or
# behind a match. Their own tests use brute force.
WITHOUT_SQL = {"op3_language_id", "op5_pattern_packing", "op6_toxicity_crf", "op7_line_dedup", "op10_quality", "op13_personal_data"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple("null" if v is None else repr(v) for v in row) for row in zip(*columns))


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_same_as_sql(spark, duck, name):
    made = queries.QUERIES[name](spark, SF).toArrow()
    wanted = duck.sql(oracle.sql()[name]).to_arrow_table()
    names = sorted(made.column_names)
    assert names == sorted(wanted.column_names)
    assert [made.schema.field(c).type for c in names] == [wanted.schema.field(c).type for c in names]
    assert rows(made) == rows(wanted)


def test_all_are_registered():
    assert set(queries.QUERIES) - set(oracle.sql()) == WITHOUT_SQL
    assert set(queries.QUERIES) | {"pipeline"} <= set(entries.queries()) and set(oracle.sql()) <= set(entries.oracle_sql())


def test_native_query_runs_no_python(spark):
    plan = queries.op8_url_reputation(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
