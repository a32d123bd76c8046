"""Helpers of reports and evaluation on made rows."""

import pytest
from pyspark.sql import functions as F

from kelpline.functions.dates import month_of_name
from kelpline.functions.rules import complaint_headline, display_type
from kelpline.functions.text import escaped, short_hash
from kelpline.plans.evaluation_queries import passed, profile_examples, report_lines, swept
from kelpline.sources.readers import lines_of
from kelpline.sources.sinks import write_lines


def applied(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    return [r.x for r in rows.select("k", f(F.col("c")).alias("x")).orderBy("k").collect()]


def test_month_names(spark):
    texts = ["March 2020", " sept  1999 and on", "MAY 2001", "Sep 2001", "Marchember 2020", "in March 2020", "March 20", "", None, "mar2020"]
    assert applied(spark, month_of_name, texts) == ["2020-03", "1999-09", "2001-05", "2001-09", None, None, None, None, None, None]


def test_types_as_shown(spark):
    texts = ["vacuum-upright/canister", "vacuum-other", "vacuum-stick", "iron/steamer", "accessory/part", "blender", "", None]
    assert applied(spark, display_type, texts) == ["upright or canister vacuum", "vacuum", "stick vacuum", "iron or steamer", "accessory or part", "blender", "", ""]


def test_report_text(spark):
    assert applied(spark, lambda c: escaped(c, 5), ["<a>&'\"x", "ab\ncd", "ab", None, ""]) == ["&lt;a&gt;&amp;&#x27;…", "ab cd", "ab", "", ""]
    assert applied(spark, short_hash, ["abc", None]) == ["ba7816bf8f01cfea", None]


@pytest.mark.parametrize(
    "own, peers, text",
    [(0.26, 0.2, "Leaks leads complaints, 1.3x the peer rate"), (0.1, 0.2, "Leaks leads complaints, below the peer rate"), (0.2, 0.2, "Leaks leads complaints, close to the peer rate"), (0.2, 0.0, "Leaks leads complaints"), (0.2, None, "Leaks leads complaints"), (0.0, 0.2, "Owners report a spread of complaints, none dominant"), (None, 0.2, "Owners report a spread of complaints, none dominant")],
)
def test_headline(spark, own, peers, text):
    row = spark.createDataFrame([(own, peers)], "own double, peers double").select(complaint_headline(F.lit("Leaks"), F.col("own"), F.col("peers")).alias("x")).first()
    assert row.x == text


def test_lines_pass_through_unparsed(spark):
    lines = ['{"parent_asin": "A", "x": "ü, \\" "}', '{"x": 1, "parent_asin": "B"}', '{"parent_asin": "C", "parent_asin": "A"}', "not json", "", '{"parent_asin": "a"}']
    ids = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "id string")
    got = lines_of(spark.createDataFrame([(x,) for x in lines], "value string"), ids)
    assert sorted(r.value for r in got.collect()) == sorted(lines[:2])


def test_thresholds(spark):
    got = applied(spark, lambda c: passed(c.cast("double"), 20, 90, 2), ["0.19", "0.2", "0.219", "0.22", "0.58", "0.9", "1.0", "0"])
    assert got == [0, 1, 1, 2, 20, 36, 36, 0]
    counts = spark.createDataFrame([(0, 3, 5), (1, 1, 2), (36, 2, 0)], "k int, pos long, neg long")
    rows = {r.threshold: (r.tp, r.fp, r.fn, r.f1) for r in swept(counts, [], (20, 90, 2)).collect()}
    assert rows[0.2] == (3, 2, 3, 0.545) and rows[0.22] == rows[0.9] == (2, 0, 4, 0.5) and len(rows) == 36


def test_profile(spark):
    rows = spark.createDataFrame([(4, "b", None), (1, "a", " "), (2, "b", "None"), (3, "c", "x"), (5, "d", "x")], "id int, s string, t string")
    got = {r.column_name: (r.n_rows, r.n_filled, r.n_distinct, r.examples) for r in profile_examples(rows, "id").collect()}
    assert got == {"s": (5, 5, 4, "a | b | c"), "t": (5, 2, 1, "x")}
    assert profile_examples(rows.limit(0), "id").count() == 0


def test_report(spark, tmp_path):
    metrics = spark.createDataFrame([("rows", 3.0), ("f1", 0.5)], "name string, value double")
    write_lines(report_lines(metrics, "Matcher"), "value", str(tmp_path / "r"))
    text = sorted(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in text).splitlines() == ["# Matcher", "", "- f1: 0.5", "- rows: 3.0"]
