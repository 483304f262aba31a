import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline.functions import dates, features, numbers, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw,label",
    [
        ("4-ROOM", "4 ROOM"),
        (" multi/generation ", "MULTI GENERATION"),
        ("a   b", "A  B"),
        (" x　", "X"),
        ("2 - room", "2  ROOM"),
        (None, None),
    ],
)
def test_label(spark, raw, label):
    assert one(spark, text.label(F.lit(raw).cast("string"))) == label


def test_label_to_feature_and_back(spark):
    name = text.feature_name(F.lit("4 NOT SPECIFIED"))
    assert one(spark, name) == "flat_type_4_NOT_SPECIFIED"
    assert one(spark, text.label_of_feature(name)) == "4 NOT SPECIFIED"
    assert one(spark, text.loose_key(F.lit("4-not_spec ified"))) == "4NOTSPECIFIED"
    assert one(spark, text.file_key(F.lit("4 Room"))) == "4_room"
    assert one(spark, text.title(F.lit("price_prediction"))) == "Price Prediction"


def test_words_are_those_of_python(spark):
    odd = "".join(chr(c) for c in range(1, 0x3100)) + " a b"
    for body in ["", "  ", "one", "a b\x1cc\x85d", odd, "x" * 5 + "\n\ty z "]:
        assert one(spark, text.word_count(F.lit(body))) == len(body.split())
    assert all(c.isspace() for c in text.SPACES)
    assert [chr(c) for c in range(0x10000) if chr(c).isspace()] == sorted(text.SPACES)


def test_mentions(spark):
    words = F.array(F.lit("PRICE"), F.lit("pros"))
    assert one(spark, text.share_mentioned(F.lit("A pricier flat, with prospects"), words)) == 0.5
    assert one(spark, text.share_mentioned(F.lit("x"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, text.mentions(F.lit("a.c"), F.lit("A.C")))
    assert not one(spark, text.mentions(F.lit("abc"), F.lit("a.c")))


@pytest.mark.parametrize("items", [[], ["a", "b c"], ["it's"], ["both ' and \""], ["back\\slash", "line\nbreak\ttab"]])
def test_shown_list_is_the_list_of_python(spark, items):
    column = F.array(*[F.lit(i) for i in items]).cast("array<string>")
    assert one(spark, text.shown_list(column)) == repr(items)


def test_table_cell(spark):
    assert one(spark, text.table_cell(F.lit("a\nb|c"))) == "a b\\|c"
    assert one(spark, text.table_cell(F.lit("a\nb|c"), keep_lines=True)) == "a\nb\\|c"


def test_rounding(spark):
    assert one(spark, numbers.half_even(F.lit(2.5), 0)) == 2.0
    assert one(spark, numbers.half_away(F.lit(2.5), 0)) == 3.0
    assert one(spark, numbers.half_away(F.lit(-0.125), 2)) == -0.13


def test_guards(spark):
    assert one(spark, numbers.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.change_or_zero(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, numbers.change_or_zero(F.lit(1.0), F.lit(None).cast("double"))) == 0.0
    assert one(spark, numbers.change_or_null(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.change_or_null(F.lit(3.0), F.lit(2.0))) == 50.0
    assert one(spark, numbers.at_least(F.lit(None).cast("double"), 0.0)) is None
    assert one(spark, numbers.clamp(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, numbers.clamp(F.lit(5.0), F.lit(0.0), F.lit(1.0))) == 1.0
    assert one(spark, numbers.scaled(F.lit(5.0), F.lit(5.0), F.lit(5.0))) == 0.0
    assert one(spark, numbers.axis_pad(F.lit(10.0), F.lit(20.0))) == pytest.approx(0.6)
    assert one(spark, numbers.axis_pad(F.lit(0.5), F.lit(0.5))) == pytest.approx(0.06)


def test_number_formats(spark):
    assert one(spark, numbers.money(F.lit(1234567.4))) == "SGD 1,234,567"
    assert one(spark, numbers.money(F.lit(None).cast("double"))) == "SGD —"
    assert one(spark, numbers.money(F.lit(1234.5), 2)) == "SGD 1,234.50"
    assert one(spark, numbers.signed_percent(F.lit(1.25))) in ("+1.2%", "+1.3%")
    assert one(spark, numbers.signed_percent(F.lit(-3.21))) == "-3.2%"
    assert one(spark, numbers.fixed(F.lit(0.0625), 3)) == f"{0.0625:.3f}"
    assert one(spark, numbers.fixed(F.lit(None).cast("double"), 3)) == "N/A"
    assert one(spark, numbers.kilometres(F.lit(1.5))) == "1.50 km"
    assert one(spark, numbers.lenient_number(F.lit("x1"))) is None
    assert one(spark, numbers.lenient_number(F.lit("1.5"))) == 1.5


def test_dates(spark):
    day = F.lit(dt.date(2024, 1, 31))
    assert one(spark, dates.month_start(day)) == dt.date(2024, 1, 1)
    assert one(spark, dates.month_name(day)) == "Jan 2024"
    assert one(spark, dates.long_month_name(day)) == "January 2024"
    assert one(spark, dates.year_month(day)) == "2024-01"
    assert one(spark, dates.lenient_date(F.lit("no date"))) is None
    with pytest.raises(Exception):
        one(spark, dates.strict_date(F.lit("no date")))
    gap = dates.month_number(F.lit(dt.date(2024, 1, 1))) - dates.month_number(F.lit(dt.date(2022, 11, 1)))
    assert one(spark, gap) == 14


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.unit(a)) == [0.6, 0.8]
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [None, None]
    assert one(spark, vectors.cosine(a, F.array(F.lit(4.0), F.lit(3.0)))) == pytest.approx(0.96)
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_town_regions(spark):
    assert one(spark, features.town_region(F.lit("YISHUN"))) == "region_North"
    assert one(spark, features.town_region(F.lit("ATLANTIS"))) is None
    assert len(features.TOWN_REGION) == 26


def test_matching_feature(spark):
    columns = ["district_number", "flat_type_4_ROOM", "flat_type_3 ROOM", "flat_type_MULTI-GENERATION"]
    found = {
        label: one(spark, features.matching_feature(F.lit(label), columns))
        for label in ("4 ROOM", "3 ROOM", "MULTI GENERATION", "5 ROOM")
    }
    assert found == {
        "4 ROOM": "flat_type_4_ROOM",
        "3 ROOM": "flat_type_3 ROOM",
        "MULTI GENERATION": "flat_type_MULTI-GENERATION",
        "5 ROOM": None,
    }


def test_request_features_and_alignment(spark):
    asked = spark.createDataFrame(
        [(1, "4-room", "YISHUN", 90.0, None), (2, "penthouse", "ATLANTIS", 50.0, 60.0)],
        "id int, flat_type string, town string, floor_area_sqm double, remaining_lease double",
    )
    flat, regions = ["flat_type_4_ROOM"], ["region_North"]
    rows = features.request_features(asked, flat, regions, features.town_region(F.col("town")), keep=["id"])
    wanted = ["region_North", "flat_type_4 ROOM", "floor_area_sqm", "remaining_lease", "no such feature"]
    made = [tuple(r) for r in features.aligned(rows, wanted, keep=["id"]).orderBy("id").collect()]
    assert made == [(1, 1.0, 1.0, 90.0, 0.0, 0.0), (2, 0.0, 0.0, 50.0, 60.0, 0.0)]


def test_category_limit(spark):
    many = spark.range(1001).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        features.categories(many, F.col("c"))
    assert features.categories(many.where("id < 3").selectExpr("c"), F.col("c")) == ["0", "1", "2"]


def test_numbers_as_they_are_printed(spark):
    """Rounded on the exact value of the double; only true ties go to the even digit."""
    given = [0.125, 2.675, 0.25, 1.005, 12345.678, -0.25, 0.0]
    df = spark.createDataFrame([(v,) for v in given], "v double").coalesce(1)
    v = F.col("v")
    rows = df.select(numbers.kilometres(v), numbers.signed_percent(v), numbers.fixed(v, 2), numbers.fixed(v, 3)).collect()
    assert [tuple(r) for r in rows] == [(f"{x:.2f} km", f"{x:+.1f}%", f"{x:.2f}", f"{x:.3f}") for x in given]
    empty = spark.range(1).select(F.lit(None).cast("double").alias("v"))
    assert tuple(empty.select(numbers.kilometres(v), numbers.signed_percent(v), numbers.fixed(v, 2)).first()) == (None, None, "N/A")


def test_onehot_features_map_every_town(spark, tmp_path):
    import datetime as dt

    from hearthline.plans import registry, tables

    spark.createDataFrame([("Asia",)], "r_name string").write.parquet(str(tmp_path / "region.parquet"))
    rows = [(dt.date(2020, 1, 1), "BEDOK", "1-URGENT", "Asia", 5.0), (None, "elsewhere", None, None, None), (None, None, None, None, 1.0)]
    spark.createDataFrame(rows, "month date, town string, flat_type string, region string, resale_price double").write.parquet(
        str(tmp_path / "sales")
    )
    spark.conf.set(tables.SALES_TABLE, str(tmp_path / "sales"))
    try:
        found = registry.onehot_features(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(tables.SALES_TABLE)
    assert {r["town"]: r["mapped_region"] for r in found} == {"BEDOK": "region_East", "elsewhere": None, None: None}
