import datetime as dt

import pytest

from hearthline.schema import SALES, named_as, require
from hearthline.runtime import durable, shared_folder
from hearthline.sources import corpus, tables


def test_csv_is_loaded_once(spark, tmp_path):
    raw, table = str(tmp_path / "raw.csv"), str(tmp_path / "table")
    open(raw, "w").write("month,town,resale_price\n2020-01-01,T,NaN\n2020-02,,5.5\n")
    schema = "month date, town string, resale_price double"
    rows = sorted(tuple(r) for r in tables.load_once(spark, raw, table, spark.createDataFrame([], schema).schema).collect())
    assert rows == [(dt.date(2020, 1, 1), "T", None), (dt.date(2020, 2, 1), None, 5.5)]
    open(raw, "w").write("month,town,resale_price\n")
    assert tables.load_once(spark, raw, table).count() == 2


def test_a_date_that_is_none_fails(spark, tmp_path):
    raw = str(tmp_path / "raw.csv")
    open(raw, "w").write("month\nsoon\n")
    with pytest.raises(Exception, match="soon"):
        tables.read_csv(spark, raw, spark.createDataFrame([], "month date").schema).collect()


@pytest.mark.parametrize("row", ["2020-01,A,abc", "2020-01,A", "2020-01,A,1.0,2.0"])
def test_bad_rows_fail(spark, tmp_path, row):
    raw = str(tmp_path / "raw.csv")
    open(raw, "w").write(f"month,town,resale_price\n2020-02,B,2.5\n{row}\n")
    schema = spark.createDataFrame([], "month date, town string, resale_price double").schema
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.load_once(spark, raw, str(tmp_path / "table"), schema)


def test_bad_json_fails(spark, tmp_path):
    good = '{"area": "A", "hdb_price_range": "x", "pros": ["p"], "cons": []}'
    for n, bad in enumerate(('{"area": "B", "pros": 5', '{"area": "B", "hdb_price_range": "x", "pros": "p", "cons": []}')):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "a.json").write_text(good + "\n" + bad + "\n")
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            corpus.read_areas(spark, str(folder), lines=True).collect()


def test_inferred_types(spark, tmp_path):
    raw = str(tmp_path / "raw.csv")
    open(raw, "w").write("a,b\n1,x\n")
    assert tables.read_csv(spark, raw, None).dtypes == [("a", "int"), ("b", "string")]


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "id as other", "'x' as wide").write.parquet(table)
    plan = tables.scan(spark, table, ["id"]).where("id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,3)" in plan
    with pytest.raises(ValueError, match="absent"):
        tables.scan(spark, table, ["absent"])


def test_partitioned_csv(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([("T", "4 ROOM", 1.5), ("U", "3 ROOM", 2.5)], "town string, flat_type string, price double")
    tables.write_csv(df, folder, ["town", "flat_type"])
    assert (tmp_path / "out" / "town=T" / "flat_type=4 ROOM").is_dir()
    back = tables.read_csv(spark, folder, df.schema).select(*df.columns)
    assert sorted(tuple(r) for r in back.collect()) == [("T", "4 ROOM", 1.5), ("U", "3 ROOM", 2.5)]


def test_results_carry_their_time(spark, tmp_path):
    tables.write_results(spark.createDataFrame([("m", 0.5)], "metric string, score double"), str(tmp_path / "r"))
    row = spark.read.parquet(str(tmp_path / "r")).first()
    assert row["score"] == 0.5 and row["evaluated_at"] is not None


def test_columns_are_checked_and_renamed(spark):
    df = spark.createDataFrame([(1,)], "sale_month int")
    assert named_as(df, {"month": "sale_month"}).columns == ["month"]
    with pytest.raises(ValueError, match="price"):
        require(df, ["sale_month", "price"])
    assert len(SALES) == 21


def test_durable_has_a_known_size(spark):
    kept = durable(spark.range(10).selectExpr("id", "id % 3 as k"))
    assert kept.count() == 10
    joined = spark.range(10**6).join(kept, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined


def test_sales_are_stored_by_content_not_by_application(spark):
    from hearthline.plans.tables import sales_table
    from hearthline.sources import files

    path = sales_table(spark, "/root/testdata/sf0.001")
    assert spark.sparkContext.applicationId not in path and files.exists(spark, path + "/_SUCCESS")
    assert sales_table(spark, "/root/testdata/sf0.001") == path


class FakeSpark:
    """Just enough of a session to see where stored steps would go."""

    def __init__(self, setting, folder, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: setting if key == "spark.checkpoint.dir" else default)})
        self.folder, self.sparkContext, self.master = folder, self, master

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder():
    assert shared_folder(FakeSpark("hdfs://shared/steps/", None, "yarn")) == "hdfs://shared/steps"
    assert shared_folder(FakeSpark(None, "hdfs://set/by/job", "yarn")) == "hdfs://set/by/job"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(FakeSpark(None, None, "spark://master:7077"))
    alone = FakeSpark(None, None, "local[2]")
    assert shared_folder(alone) == alone.folder


def test_sales_are_shuffled_before_their_columns_are_made(spark, tmp_path):
    from pyspark.sql import functions as F

    from hearthline.plans import tables as given

    made = {
        "lineitem": spark.sql(
            "SELECT if(id % 7 = 0, NULL, id % 5) l_orderkey, if(id % 11 = 0, NULL, id % 3) l_partkey, id % 9 l_suppkey, int(id) l_linenumber, "
            "double(id % 4 + 1) l_quantity, double(id) l_extendedprice, timestamp '1996-01-17' + make_interval(0, int(id % 6)) l_shipdate FROM range(90)"
        ),
        "orders": spark.sql("SELECT if(id = 6, NULL, id % 4) o_orderkey, if(id = 2, NULL, id % 3) o_custkey, concat(id, '-X') o_orderpriority FROM range(7)"),
        "customer": spark.sql("SELECT if(id = 4, NULL, id % 2) c_custkey, if(id = 1, NULL, int(id % 3)) c_nationkey FROM range(5)"),
        "nation": spark.sql("SELECT int(id % 2) n_nationkey, concat('N', id) n_name, if(id = 2, NULL, int(id)) n_regionkey FROM range(3)"),
        "region": spark.sql("SELECT int(id) r_regionkey, concat('R', id) r_name FROM range(2)"),
        "part": spark.sql("SELECT id % 2 p_partkey, concat('B', id) p_brand, int(id) p_size FROM range(3)"),
    }
    for name, rows in made.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    found = given.joined_sales(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "storey_range" not in plan[plan.index("RebalancePartitions") :]
    plain = made["lineitem"]
    for name, on in [
        ("orders", "l_orderkey = o_orderkey"), ("customer", "o_custkey = c_custkey"), ("nation", "c_nationkey = n_nationkey"),
        ("region", "n_regionkey = r_regionkey"), ("part", "l_partkey = p_partkey"),
    ]:
        plain = plain.join(made[name], F.expr(on), "left")
    plain = plain.select(*[F.expr(c).cast(SALES[n].dataType).alias(n) for n, c in given.SALES_COLUMNS.items()])
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and plain.count() > 90
