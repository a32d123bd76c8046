"""Tools with texts and themes, and the same tools through SQL with bound arguments."""

import pytest
from pyspark.sql import functions as F

from kelpline.plans.product_tools import Bars, ProductTools, tools_of
from kelpline.plans.sql_tools import FUNCTIONS, call, register_tools
from kelpline.plans.tools import ToolError, Tools

HOSTILE = ["%", "_", "'; DROP VIEW tool_reviews; --", "\\' OR 1=1 --", ':product "', "${x} {0} `", "a\u0000b */ /*", "(?i).*"]


@pytest.fixture(scope="module")
def tools(spark, data):
    register_tools(spark, data)
    return tools_of(spark, data)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_sql_tools_equal_the_dataframe_tools(spark, data, tools):
    base = Tools(spark, data)
    same(call(spark, "find_products", wanted="la1", top=99), tools.find("la1", limit=99))
    same(call(spark, "find_products", wanted=" Ring  red ", kind="Smalls", accessories=True), tools.find("Ring red", "Smalls", include_accessories=True))
    same(call(spark, "find_products", wanted="brand#7", line="Brand#7", top=0), tools.find("brand#7", family="Brand#7", limit=0))
    for first, last in ((None, None), ("1996-01", "1994-05"), ("1980-01", "2040-01")):
        same(call(spark, "product_timeline", product=1, first=first, last=last), base.get_product_timeline(1, first, last))
    same(call(spark, "product_timeline", product=1, way="refurbished"), base.get_product_timeline(1, channel="refurbished"))
    same(call(spark, "product_complaints", product=1), base.get_product_complaints(1))
    same(call(spark, "compare_product_type", kind="economys"), base.compare_product_type("economy"))
    same(call(spark, "find_cases", top=3), base.find_cases(limit=3))
    for metric in ("most_reviewed", "highest_rated", "lowest_rated", "low_share", "rating_change", "early_failures"):
        same(call(spark, "rank_products", metric=metric, least=3), base.rank_products(metric, min_reviews=3))
    same(call(spark, "findings"), base.get_findings())
    same(call(spark, "search_reviews", product=2, wanted="THE", least=-4, most=4, by_help=True), tools.search(2, contains="THE", min_rating=-4, max_rating=4, sort="helpful"))
    same(call(spark, "search_reviews", product=2, first="1993-01-09", last="2050-01", way="new", top=2), tools.search(2, "1993-01-09", "2050-01", "new", limit=2))
    same(call(spark, "set_view", product=1, first="2003-01", last="1995-01"), base.set_view(1, "2003-01", "1995-01").drop("channels"))
    assert len(FUNCTIONS) == 9


@pytest.mark.parametrize("text", HOSTILE)
def test_hostile_arguments_are_text(spark, tools, text):
    same(call(spark, "find_products", wanted=text, kind=None), tools.find(text))
    same(call(spark, "search_reviews", product=1, wanted=text), tools.search(1, contains=text))
    assert call(spark, "compare_product_type", kind=text).count() == call(spark, "product_timeline", product=1, way=text).count() == call(spark, "rank_products", metric=text).count() == 0
    assert spark.table("tool_reviews").limit(1).count() == 1


def test_unknown_tools_and_arguments(spark, tools):
    for name, arguments in (("drop_all", {}), ("findings) --", {}), ("set_view", {"product": 1, "x => 1) --": 2})):
        with pytest.raises(ToolError):
            call(spark, name, **arguments)


def test_search_counts_all_and_shows_few(spark, data, tools):
    got = tools.search(1, limit=2).collect()
    n = tools.numbered.filter("unit_id = 1").count()
    assert len(got) == 2 < n == got[0]["matching"] and all(len(r["excerpt"]) <= 350 for r in got)
    for ask in (lambda: tools.search(-1), lambda: tools.search(1, channel="x"), lambda: tools.search(1, sort="x"), lambda: tools.search(1, theme="nothing"), lambda: tools.search(1, "soon"), lambda: tools.rank("complaint_share"), lambda: tools.rank("x"), lambda: tools.find(" ")):
        with pytest.raises(ToolError):
            ask()
    assert tools.search(1, contains="no such words").collect() == []


def test_the_24_themes_and_few_low_ratings(spark, data):
    every = ProductTools(spark, data)
    assert len(every.themes) == 24 and every.theme("Battery runtime") == "battery_runtime" and every.theme("steam") == "no_steam"
    assert {r["section"] for r in every.complaints(1).collect()} == {"new_units"}
    few = ProductTools(spark, data, bars=Bars(low=1, year=1, change=2, rise=0.01))
    got = few.complaints(1).collect()
    assert {"new_units", "top_complaints", "warranty_service", "by_year", "type_own"} <= {r["section"] for r in got}
    assert sum(r["section"] == "top_complaints" for r in got) == 6
    alone = ProductTools(spark, data, bars=Bars(low=10**6)).compare_type("economy").collect()
    assert alone and all(r["peers"] is None for r in alone)


def test_ranks_leave_accessories_out(spark, tools):
    own = tools.rank("reviews_new", min_reviews=0).collect()
    accessories = {r[0] for r in tools.catalogue.filter("is_accessory").select("unit_id").collect()}
    assert len(own) == 10 and not {r["unit_id"] for r in own} & accessories and [r["value"] for r in own] == sorted((r["value"] for r in own), reverse=True)
    assert tools.rank("avg_rating_new", family="no such line").collect() == [] and tools.rank("low_star_share", min_reviews=1).filter(F.col("value") > 1).count() == 0
