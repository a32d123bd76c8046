"""Sources, sinks, operators and tools."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kelpline.operators.relational import benjamini_hochberg, column_profile, cooled_down, dense_months, few_ids, label_components
from kelpline.plans.tools import ToolError, Tools
from kelpline.sources import readers, sinks


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_table(spark, tmp_path):
    with pytest.raises(readers.SourceError):
        readers.read_table(spark, str(tmp_path), "nothing")


def test_jsonl_reviews(spark, tmp_path):
    rows = [
        {"user_id": "u", "parent_asin": "p", "asin": "p", "timestamp": 1534118400000, "rating": 5.0, "verified_purchase": True, "helpful_vote": 1, "title": "t", "text": " ok "},
        {"user_id": "u", "parent_asin": "p", "asin": "v", "timestamp": 1534118400000, "rating": 1.0, "verified_purchase": None, "helpful_vote": 0, "title": None, "text": None},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    raw = readers.read_jsonl(spark, str(path), readers.REVIEW).filter("user_id is not null")
    launches = spark.createDataFrame([("p", datetime.date(2018, 8, 14))], "parent_asin string, launch_date date")
    got = readers.clean_reviews(raw, launches).orderBy("asin").collect()
    assert [(r["review_text"], r["before_launch"], r["is_variant_asin"], str(r["review_month"])) for r in got] == [("ok", True, False, "2018-08-01"), (None, True, True, "2018-08-01")]
    assert len({r["review_id"] for r in got}) == 2


def test_json_documents(spark, tmp_path):
    df = spark.createDataFrame([("a/b", float("nan"), 1.23456, datetime.date(2020, 1, 2), None)], "k string, x double, y double, d date, n string")
    assert json.loads(sinks.documents(df).first()["json"]) == {"k": "a/b", "x": None, "y": 1.2346, "d": "2020-01-02", "n": None}
    sinks.write_documents(df, "k", str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a_b.json"] and json.loads((tmp_path / "out" / "a_b.json").read_text())["y"] == 1.2346
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), "k string, x double, y double, d date, n string").count() == 1
    sinks.write_lines(df, "k", str(tmp_path / "lines"))
    assert readers.read_lines(spark, str(tmp_path / "lines")).first()["value"] == "a/b"


def test_cooldown(spark):
    df = spark.createDataFrame([("k", m) for m in (1, 3, 6, 7, 14, 15)], "k string, m int")
    assert cooled_down(df, ["k"], "m", 6).first()["fired"] == [1, 7, 14]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 6), (6, 7), (7, 4)], "a long, b long")
    assert {r["node"]: r["comp"] for r in label_components(links).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4, 5: 4, 6: 4, 7: 4}


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    got = benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p", 0.05).orderBy("p").collect()
    assert [r["survives"] for r in got] == [True, True] + [False] * 6 and [r["p_rank"] for r in got] == list(range(1, 9))


def test_profile_of_empty(spark):
    assert column_profile(spark.createDataFrame([], "a string, b int")).count() == 2


def test_tools(spark, data):
    tools = Tools(spark, data)
    assert tools.find_products("a", limit=99).count() <= 10
    for call in (lambda: tools.get_product_timeline(-1), lambda: tools.rank_products("nonsense"), lambda: tools.product_type("toaster pastry"), lambda: tools.get_product_timeline(1, channel="x"), lambda: tools.get_product_timeline(1, "soon")):
        with pytest.raises(ToolError):
            call()
    kind = tools.units.first()["product_type"]
    assert tools.product_type(kind.lower() + "s") == kind
    values = [r["value"] for r in tools.rank_products("low_share").collect()]
    assert values == sorted(values, reverse=True)
    view = tools.set_view(1, "2003-01", "1995-01").first()
    assert view["first"] <= view["last"] <= "2001-11" and view["channels"] == "new,refurbished"


def test_llm_is_optional():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "kelpline"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)\s+[\w.]*llm", path.read_text()), path


def test_named_columns_are_unique(spark, data):
    df = entry.queries()["drift"](spark, data)
    assert df.columns == list(dict.fromkeys(df.columns)) and df.filter(F.col("change").isNull()).count() == 0


def test_dense_months_list_the_months_between_cells_without_a_join(spark):
    """Gaps, equal months, months after the last and null ones; cells alone are dealt out by key, so no grid of months is shuffled."""
    day = lambda m: datetime.date(2001, m, 1) if m else None
    rows = [("a", day(2), 3, 3, "x"), ("a", day(5), None, 7, "y"), ("a", day(12), 9, 9, "z"), ("a", None, 1, 1, "w"), ("b", day(11), 1, 1, "v"), ("c", day(12), 1, 1, "u"), ("d", day(10), 1, 1, "s"), ("d", day(10), 2, 2, "t")]
    cells = spark.createDataFrame(rows, "k string, m date, n long, total long, name string").repartition(3)
    df = dense_months(cells, ["k"], "m", F.lit(day(11)), ["n"], ["total"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2  # the test's own repartition, and one by key
    got = sorted(((r["k"], r["m"].month, r["n"], r["name"]) for r in df.collect()), key=repr)
    want = [("a", m, {2: 3}.get(m, 0), {2: "x", 5: "y"}.get(m)) for m in range(2, 12)] + [("b", 11, 1, "v"), ("d", 10, 1, "s"), ("d", 10, 2, "t"), ("d", 11, 0, None)]
    assert got == sorted(want, key=repr) and {(r["m"].month, r["total"]) for r in df.filter("k = 'a'").collect()} == {(m, 3 if m < 5 else 7) for m in range(2, 12)}


def test_ids_of_few(spark):
    rows = [(k, i) for k, ids in {"one": [5], "two": [9, -4], "three": [7, 2**62, -(2**63)], "four": [1, 2, 3, 4], "null": [None]}.items() for i in ids]
    got = {r["k"]: r["ids"] for r in spark.createDataFrame(rows, "k string, v long").groupBy("k").agg(few_ids("v").alias("ids")).collect()}
    assert got == {"one": [5], "two": [-4, 9], "three": [-(2**63), 7, 2**62], "four": None, "null": None}
