"""Queries on tables with large groups: right, and without rows by the square of a group."""

import os
import subprocess
import sys

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpline.operators import text_index
from kelpline.operators.text_index import search, trigrams, write_index
from kelpline.plans.all import ORACLE, QUERIES


def most_rows(df) -> int:
    """The largest number of rows that an operator of the plan made, of those that ran."""

    def found(node):
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ResultQueryStageExec"):
            node = node.executedPlan() if hasattr(node, "executedPlan") and node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan()
            return found(node)
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return found(node.plan())
        metric = node.metrics().get("numOutputRows")
        kids = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *(found(kids.apply(k)) for k in range(kids.size()))])

    return found(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def one_group(spark, data, tmp_path_factory):
    """All parts but three are of one brand and type; one key is there twice, of two brands."""
    out = str(tmp_path_factory.mktemp("group"))
    part = spark.read.parquet(f"{data}/part.parquet")
    same = part.withColumns({"p_brand": F.when(F.col("p_partkey") <= 3, F.lit("Brand#2")).otherwise(F.lit("Brand#1")), "p_type": F.lit("SMALL")})
    again = same.filter("p_partkey = 7").withColumn("p_brand", F.lit("Brand#2"))
    same.unionByName(again).coalesce(1).write.parquet(f"{out}/part.parquet")
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def test_siblings_of_one_large_group(spark, one_group):
    """Units meet months, not each other: the reviews are 6,000 and the pairs of units far more."""
    df = QUERIES["sibling_events"](spark, one_group)
    assert oracle.differences(df, oracle.connect(one_group), ORACLE["sibling_events"]) == ""
    assert most_rows(df) < 8_000


def test_postings_of_a_block_are_a_row_a_gram(spark, tmp_path):
    """2,000 texts of the same words and odd ones: the pairs of gram and text are far more than the rows of postings, and these hold the grams that Spark finds."""
    odd = [None, "", "a", "ab", "abc", "Stra\u00dfe \u0130", "\U0001f600\U0001f601\U0001f602\U0001f603", "abc"]
    rows = [(i, f"some of the words number {i % 7}") for i in range(2000)] + list(enumerate(odd, 5000)) + [(5000, "abc again")]
    docs = spark.createDataFrame(rows, "id long, text string")
    write_index(docs, str(tmp_path / "i"), parts=3)
    postings = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert postings.count() < 1000
    want = docs.filter("text is not null").select(F.explode(trigrams(F.col("text"))).alias("gram"), "id")
    got = postings.select("gram", F.explode("ids").alias("id"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert sorted(r["id"] for r in search(spark, str(tmp_path / "i"), "ABC").collect()) == [5000, 5004, 5007]


def test_blocks_of_postings_are_cut(monkeypatch):
    """Blocks, long rows and alphabets too large for one number give the same pairs."""
    texts = ["abcabc", "", "bcab", "ab", "xabc" * 5]
    want = sorted({(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["id", "text"])
    for chars, ids in ((1 << 22, 1 << 16), (8, 1), (1, 2), (12, 1)):
        monkeypatch.setattr(text_index, "BLOCK_CHARS", chars)
        monkeypatch.setattr(text_index, "ROW_IDS", ids)
        rows = [r for b in text_index._postings(iter([batch])) for r in b.to_pylist()]
        assert sorted((r["gram"], i) for r in rows for i in r["ids"]) == want and all(r["first"] == r["ids"][0] and len(r["ids"]) <= ids for r in rows)
    many = ["".join(chr(0x20000 + 7 * i + k) for k in range(40_000)) for i in range(3)]
    big = text_index._block_postings(np.arange(3), many)
    assert sum(len(r["ids"]) for b in big for r in b.to_pylist()) == 3 * 39_998


RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__
print("found", __spark_entry__.queries()["substring_search"](spark, {data!r}).count())
"""


def test_the_index_needs_no_copy_at_workers(data, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", RUN.format(repo=repo, shared=str(tmp_path / "shared"), data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found" in run.stdout, run.stderr[-3000:]
