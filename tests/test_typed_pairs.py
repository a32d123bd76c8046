"""Pairs made by types against all pairs of a block."""

import pytest
from pyspark.sql import functions as F
from test_matching import catalogue

from kelpline.functions.rules import pair_features
from kelpline.operators import typed_pairs
from kelpline.operators.event_study import hashed, hashed_under
from kelpline.operators.typed_pairs import each_item, each_pair, pair_count, price_bounds, type_pairs
from kelpline.plans.evaluation_queries import gaps

NAMES = ("jac", "relation", "strict", "cross", "apart", "same")


@pytest.fixture(scope="module")
def rows(spark):
    return catalogue(spark, 120, 3).select("id", "block", "r.*").cache()


@pytest.mark.parametrize("cut", [2, 1000])
def test_pairs_and_features(spark, rows, monkeypatch, cut):
    for name in ("ROW_RECORDS", "TITLE_ROWS", "PART_RECORDS"):
        monkeypatch.setattr(typed_pairs, name, cut)
    a, b = (rows.select("block", F.struct(*rows.columns).alias(s)) for s in "ab")
    side = lambda s: {k: F.col(f"{s}.{k}") for k in rows.columns}
    f = pair_features(side("a"), side("b"))
    every = a.join(b, "block").filter("a.id < b.id").select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), *(f[k].alias(k) for k in NAMES), (F.col("a.title_norm") == F.col("b.title_norm")).alias("same_title"), f["price"].alias("price"))
    want = sorted(map(tuple, every.collect()))
    ordered = type_pairs(rows, ["block"])
    got = each_pair(ordered).select("a.id", "b.id", *NAMES, "same_title").collect()
    assert sorted(map(tuple, got)) == [w[:-1] for w in want] != []
    single = type_pairs(rows, ["block"], once=True)
    assert single.agg(F.sum(pair_count())).first()[0] == len(want) == each_item(single).count()
    prices = {frozenset(w[:2]): w[-1] for w in want}
    least, most = price_bounds()
    for r in each_item(single.select("*", least.alias("least"), most.alias("most"))).select("a.id", F.col("b.id").alias("other"), "least", "most").collect():
        p = prices[frozenset((r["id"], r["other"]))]
        assert (p is None and r["least"] is None) or r["least"] <= p <= r["most"]
    known = gaps(rows, ["block"]).collect()
    assert {r["gap"]: r["n"] for r in known if r["gap"] is not None} == {g: sum(w[-1] is not None and 1 - w[-1] == g for w in want) for g in {1 - w[-1] for w in want if w[-1] is not None}}


def test_copies_are_no_rows(spark):
    """1,000 copies of four listings at many prices: the pairs of types stay those of four."""
    rows = spark.range(1000).select("id", F.lit("b").alias("block"), F.concat(F.lit("old vacuum "), (F.col("id") % 4).cast("string")).alias("title_norm"), F.lit(None).cast("string").alias("model_no"), F.array().cast("array<string>").alias("title_model_tokens"), (F.col("id") / 7 + 1).alias("price"), F.lit("acme").alias("brand"), F.array(F.lit("old"), F.lit("vacuum")).alias("tokens"), F.array((F.col("id") % 4).cast("string")).alias("numbers"))
    pairs = type_pairs(rows, ["block"], once=True, items=False)
    assert pairs.count() == 10 and pairs.agg(F.sum(pair_count())).first()[0] == 1000 * 999 // 2


def test_share_by_digits(spark):
    rows = spark.range(3000).select(hashed("id").alias("h"), *(hashed_under(p, "id").alias(str(k)) for k, p in enumerate((0.1, 0.2, 0.75))))
    assert rows.filter("(h < 0.1) != `0` or (h < 0.2) != `1` or (h < 0.75) != `2`").count() == 0
