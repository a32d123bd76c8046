"""Quantiles of large groups, the panel after batches, and substring search by an index."""

import math
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kelpline.operators.quantiles import cumulated, exact_quantiles
from kelpline.operators.text_index import search, trigrams, write_index
from kelpline.plans.review_queries import monthly, panel_of
from kelpline.plans.upkeep import add_batch
from kelpline.sources.readers import reviews

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_percentile(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["hot", "hot", "a", "b", None]), draw.choice([None, 1.0, 1.0, 2.5, draw.gauss(0, 1), -7.0])) for _ in range(2000)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0), ("inf", float("inf")), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, QS))).alias("q")).collect() if r["q"] is not None}
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", QS).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want if k != "inf")
    every = df.filter("k != 'inf'").agg(F.percentile("v", F.array(*map(F.lit, QS))).alias("q")).first()["q"]
    assert exact_quantiles(df.filter("k != 'inf'"), [], "v", QS).first()["q"] == pytest.approx(every)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert exact_quantiles(df, ["k"], "v", [0.5]).collect() == [] and exact_quantiles(df.limit(0), [], "v", [0.5]).collect() == []
    for qs in ([], [1.1], [-0.1]):
        with pytest.raises(ValueError):
            exact_quantiles(df, ["k"], "v", qs)


def test_running_sums_over_tasks(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("w")).repartition(7)
    got = cumulated(rows, ["id"], F.col("w")).orderBy("id").collect()
    assert [r["before"] for r in got] == [sum(i % 3 for i in range(k)) for k in range(1000)]


def test_the_panel_after_batches_equals_a_rebuild(spark, data, tmp_path):
    """Three batches with late rows and one that comes again; parts without rows of a batch aren't written."""
    rv, folder = reviews(spark, data).cache(), str(tmp_path / "p")
    draw = F.crc32("review_id") % 4
    changed = lambda: {p: os.stat(os.path.join(folder, "panel", p)).st_mtime_ns for p in os.listdir(os.path.join(folder, "panel")) if p.startswith("part=")}
    for name, rows in (("a", draw < 2), ("b", draw == 2)):
        add_batch(rv.filter(rows), folder, name, parts=8)
    before = changed()
    few = rv.filter((draw == 3) & (F.col("unit_id") % 50 == 1))
    touched = add_batch(few, folder, "c", parts=8)
    after = changed()
    assert 0 < len(touched) < 8 and {p for p in after if after[p] != before.get(p)} == {f"part={k}" for k in touched}
    assert add_batch(rv.filter(draw == 2), folder, "b", parts=8) and add_batch(rv.limit(0), folder, "none", parts=8) == []
    want = panel_of(monthly(rv.filter(draw <= 2).unionByName(few)))
    got = spark.read.parquet(f"{folder}/panel").drop("part").select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


NEEDLES = ["the", "THE and", "zzzzq", "", "a", "ß", "%", "_", "' OR", "ation", "Straße", "lic", "token = \"", "\\", "İ", "released under the"]


def test_substring_search_equals_a_scan(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    odd = spark.createDataFrame([(10_000, "Straße 100% a_b \\ ' OR 1"), (10_001, "İstanbul"), (10_002, None), (10_003, ""), (None, "the")], "id long, text string")
    docs = docs.unionByName(odd)
    write_index(docs, str(tmp_path / "i"), parts=6)
    for needle in NEEDLES:
        want = {r["id"] for r in docs.filter("id is not null").filter(F.contains(F.lower("text"), F.lower(F.lit(needle)))).collect()}
        got = [r["id"] for r in search(spark, str(tmp_path / "i"), needle).collect()]
        assert set(got) == want and len(got) == len(want), needle
    assert search(spark, str(tmp_path / "i"), "released under the").count() > 0


def test_a_search_reads_few_row_groups(spark, tmp_path):
    """Of 20,000 texts the postings' row groups that statistics can't rule out for a rare word are a small part."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(12)) + (" quixotry" if i == 777 else "")) for i in range(20_000)]
    write_index(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"), parts=40)
    assert [r["id"] for r in search(spark, str(tmp_path / "i"), "Quixotry").collect()] == [777]
    grams = [r["g"] for r in spark.range(1).select(F.explode(trigrams(F.lit("quixotry"))).alias("g")).collect()]
    read = total = 0
    for f in (tmp_path / "i" / "postings").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(0).statistics
            total += 1
            read += any(stats.min <= g <= stats.max for g in grams)
    assert total >= 30 and read <= math.ceil(total / 4)
