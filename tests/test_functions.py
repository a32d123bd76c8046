"""Literals of the column functions."""

import pytest
from pyspark.sql import functions as F

from kelpline.fixed import FAIL_BANDS
from kelpline.functions import rules
from kelpline.functions.dates import banded, long_date, month_series, months_between
from kelpline.functions.text import clean_str, excerpt, generic_model_tokens, house_style, norm_brand, norm_modelno, norm_text, parse_price, title_numbers, title_tokens
from kelpline.operators.relational import settled


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


UNITS = [
    "Shark Navigator Upright Vacuum with HEPA Filter", "Ninja Blender with pitcher and blades", "Ninja Foodi Pressure Cooker with bowl", "Shark Rocket Stick Vac with brush",
    "Ninja Air Fryer 4 qt", "Shark Steam Mop with 2 pads", "Ninja Coffee Maker with reservoir", "Shark ION robot with dust bin", "Ninja Master Prep chopper with bowl",
]
PARTS = ["Filter for NV360", "Replacement Hose", "Hand Vac Filter 18355", "Dust cup 1190FC500B", "Genuine Ninja Blade", "Belt", "Lid, Ninja cup", "Brush roll compatible with NV350", "Pitcher 72 oz for blender", "Gasket", "Wand XSB726N"]


@pytest.mark.parametrize("title", UNITS)
def test_units_are_not_accessories(spark, title):
    assert value(spark, rules.is_accessory_title(F.lit(title))) is False


@pytest.mark.parametrize("title", PARTS)
def test_parts_are_accessories(spark, title):
    assert value(spark, rules.is_accessory_title(F.lit(title))) is True


@pytest.mark.parametrize(("text", "price"), [("$1,299.99", 1299.99), ("12.99 - 15.99", 14.49), ("nan", None), ("", None), (None, None), ("1.2.3", None)])
def test_parse_price(spark, text, price):
    assert value(spark, parse_price(F.lit(text).cast("string"))) == price


@pytest.mark.parametrize(("details", "title", "quarts"), [("72 Fluid Ounces", None, 2.25), ("6 Quarts", None, 6.0), ("8 Pounds", None, None), (None, "5.5-qt cooker", 5.5)])
def test_capacity(spark, details, title, quarts):
    assert value(spark, rules.capacity_qt(F.lit(details).cast("string"), F.lit(title).cast("string"))["value"]) == quarts


@pytest.mark.parametrize(("details", "title", "watts"), [("1200 watts", None, 1200.0), ("1200.00", None, 1200.0), (None, "1200", None), (None, "1500W blender", 1500.0)])
def test_wattage(spark, details, title, watts):
    assert value(spark, rules.wattage_w(F.lit(details).cast("string"), F.lit(title).cast("string"))["value"]) == watts


def test_core_model(spark):
    assert value(spark, rules.core_model(F.lit("WS642BL"))) == "WS642" and value(spark, rules.core_model(F.lit("QB751QBK"))) == "QB751"


@pytest.mark.parametrize(("text", "months", "band"), [("it died after 6 months", 6.0, "4 to 11 months"), ("lasted a couple of weeks", 2 / 4.35, "Under a month"), ("had it for 2 years", 24.0, "2 years or more"), ("no time", None, None), ("after 9 years", 108.0, None)])
def test_stated_failure(spark, text, months, band):
    got = value(spark, rules.fail_months(F.lit(text)))
    assert got == (None if months is None else pytest.approx(months)) and value(spark, rules.fail_band(rules.fail_months(F.lit(text)))) == band


def test_bands(spark):
    assert [value(spark, banded(F.lit(x), FAIL_BANDS)) for x in (0.5, 3.9, 12.0, 24.0, 1000.0)] == ["Under a month", "1 to 3 months", "About a year", "2 years or more", None]


@pytest.mark.parametrize(
    ("details", "title", "accessory", "model", "source"),
    [
        ("NV356E", "Vacuum", False, "NV356E", "details"), ("NV356E", "Vacuum (BL205)", False, "BL205", "title_explicit_over_details"), ("NV350 NV352", "Vacuum", False, None, "details_ambiguous"),
        ("1244FC500", "Filter", True, None, "details_part_only"), (None, "Filter for NV356", True, None, "accessory_no_model"), (None, "Cordless (IX141)", False, "IX141", "title_bracket"),
        (None, "Blender BL610", False, "BL610", "title"), (None, "Blender BL610 BL611", False, "BL610", "title_first_of_many"), (None, "Blender", False, None, "none"), ("B0ABCD1234", "Blender", False, None, "none"),
    ],
)
def test_extract_model(spark, details, title, accessory, model, source):
    parts = rules.model_parts(F.lit(details).cast("string"), F.lit(title), F.lit(accessory))
    got = settled(spark.range(1), parts).select(rules.choose_model().alias("x")).first()["x"]
    assert (got["model_no"], got["source"]) == (model, source)


def test_product_type(spark):
    kind = lambda cats, title: value(spark, rules.product_type(F.array(*map(F.lit, cats)) if cats else F.lit(None).cast("array<string>"), F.lit(title)))["type"]
    assert kind(["Home", "Stick Vacuums"], "Shark Rocket vacuum") == "vacuum-stick"
    assert kind(None, "Ninja coffee bar auto-iq") == "coffee maker"
    assert kind(None, "Shark vacuum + mop") == "bundle"
    assert kind(["Parts"], "Thing") == "accessory/part"
    assert kind(None, "Thing") == "unclassified"


def test_maker(spark):
    of = lambda t, a: value(spark, rules.maker(F.lit(t), F.lit(a)))
    assert [of("Teenage Mutant Ninja Turtles", False), of("Filter compatible with Shark NV350", True), of("Shark vacuum", False), of("Mop", False)] == ["unrelated", "third_party_compatible", "sharkninja", "unverified"]


def test_theme_flags(spark):
    row = spark.createDataFrame([("It stopped working and leaks. Customer service was terrible",), (None,)], "t string").select(*rules.theme_flags(F.col("t"))).collect()
    assert {k for k, v in row[0].asDict().items() if v} == {"stopped_working", "leak", "warranty_service"} and not any(row[1])


PAIR = {"title_norm": "ninja blender 72 oz", "model_no": None, "title_model_tokens": [], "price": 100.0, "brand": "ninja"}


@pytest.mark.parametrize(
    ("a", "b", "score", "reason"),
    [
        ({"model_no": "ab123"}, {"model_no": "ab123"}, 1.0, "model_equal"), ({"model_no": "ab123"}, {"model_no": "ab123x"}, 1.0, "model_prefix"), ({"model_no": "97185"}, {"model_no": "ver97185"}, 1.0, "model_contains"),
        ({"model_no": "ab123"}, {"model_no": "zz999"}, 0.0, "model_conflict"), ({"model_no": "ab123"}, {"model_no": "zz999", "title_model_tokens": ["ab123"]}, 0.9, "model_in_other_title"),
        ({}, {}, (1 + 0.1 + 0.25) / 1.7, "blended"), ({"price": None}, {}, 1.1 / 1.45, "blended"), ({"title_norm": "ninja blender 64 oz"}, {}, (3 / 5 + 0.1 + 0.25) / 1.7 - 0.3, "blended"),
    ],
)
def test_score_pair(spark, a, b, score, reason):
    schema = "title_norm string, model_no string, title_model_tokens array<string>, price double, brand string"
    rows = [spark.createDataFrame([tuple((PAIR | x).values())], schema) for x in (a, b)]
    one = rows[0].select(F.struct("*").alias("a")).join(rows[1].select(F.struct("*").alias("b")))
    side = lambda s: {k: F.col(f"{s}.{k}") for k in PAIR}
    got = one.select(rules.score_pair(side("a"), side("b")).alias("r")).first()["r"]
    assert got["score"] == pytest.approx(score) and got["reason"] == reason


def test_text(spark):
    assert value(spark, clean_str(F.lit(" a  b "))) == "a b" and value(spark, clean_str(F.lit("N/A"))) is None
    assert value(spark, norm_text(F.lit("Foo-Bar,  BAZ!"))) == "foobar baz" and value(spark, norm_brand(F.lit("Hewlett  Packard"))) == "hp" and value(spark, norm_modelno(F.lit("AB-12 3"))) == "ab123"
    assert value(spark, generic_model_tokens(F.lit("TV KDL-40 500GB kd55x"))) == ["kdl40", "kd55x"]
    assert value(spark, title_tokens(F.lit("the red tv a tv set"))) == ["tv", "set"] and value(spark, title_numbers(F.lit("4 qt and 72oz"))) == ["4qt", "72oz"]
    assert value(spark, excerpt(F.lit("x" * 300 + " leak " + "y" * 300), "leak")).startswith("…") and value(spark, excerpt(F.lit("a leak"), "leak")) == "a leak"
    assert value(spark, house_style(F.lit("Good. As an AI I can't. So — fine."), r"(?i)\bas an ai\b")) == "Good. So, fine."


def test_dates(spark):
    day = lambda t: F.lit(t).cast("date")
    assert value(spark, months_between(day("2020-01-31"), day("2020-02-01"))) == 1
    assert str(value(spark, long_date(F.lit("August 13, 2018")))) == "2018-08-13" and value(spark, long_date(F.lit("soon"))) is None
    reversed_span = spark.createDataFrame([("2020-03-01", "2020-01-01"), ("2020-01-01", "2020-03-01")], "a string, b string").select(F.size(month_series(F.col("a").cast("date"), F.col("b").cast("date"))).alias("n"))
    assert [r["n"] for r in reversed_span.collect()] == [0, 3]
