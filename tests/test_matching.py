"""Indexes of matching records against comparing all of a block."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kelpline.functions.rules import score_pair
from kelpline.functions.text import norm_text, title_numbers, title_tokens
from kelpline.operators import matching, nearest
from kelpline.operators.matching import best_after, best_of, classes_of, clustered, group_links, keyed, members, similar_sets
from kelpline.operators.relational import label_components

WORDS = ["vacuum", "upright", "navigator", "lift", "away", "pro", "cordless", "robot", "iq", "self", "empty", "filter", "bag", "cup", "blender", "coffee"]
MODELS = ["nv35", "nv356", "nv356e", "nv3560", "xnv356", "zu561", "zu56", "rv", "rv10", "ab1200", "xab1200q", "ab12"]


def catalogue(spark, n, seed, blocks=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        title = " ".join(draw.sample(WORDS, draw.randint(0, 5)) + [draw.choice(["", "5 qt", "6 qt", "12 cup"])])
        rows.append((i, draw.choice(["acme", "bell", None][:blocks]), title, draw.choice([None, None, "", *MODELS]), draw.sample(MODELS, draw.choice([0, 0, 0, 1, 2])) if i % 7 else None, draw.choice([None, 10.0, 12.5, 40.0, -1.0]), i % 11 == 0))
    rows += [(n + i, *rows[5][1:]) for i in range(15)] + [(n + 15 + i, *rows[11][1:]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, brand string, title string, model_no string, title_model_tokens array<string>, price double, exact boolean")
    df = df.withColumn("title_norm", norm_text(F.col("title")))
    r = F.struct("title_norm", "model_no", "title_model_tokens", "price", "brand", title_tokens(F.col("title_norm")).alias("tokens"), title_numbers(F.col("title_norm")).alias("numbers"))
    return df.select("id", F.to_json(F.struct("brand", "exact"), {"ignoreNullFields": "false"}).alias("block"), r.alias("r"), "exact")


def all_pairs(left, right, threshold):
    """x, y, score of all pairs of a block."""
    side = lambda s: {k: F.col(f"{s}.{k}") for k in matching.FIELDS}
    a = left.select(F.col("id").alias("x"), "block", "exact", F.col("r").alias("a"))
    b = right.select(F.col("id").alias("y"), "block", F.col("r").alias("b"))
    same = F.when(F.col("a.title_norm") == F.col("b.title_norm"), 1.0).otherwise(0.0)
    rows = a.join(b, "block").filter("x != y").withColumn("score", F.when(F.col("exact"), same).otherwise(score_pair(side("a"), side("b"))["score"]))
    return rows.filter(F.col("score") >= threshold).select("x", "y", "score").collect()


def best(pairs, digits=None):
    out = {}
    for x, y, s in sorted(pairs, key=lambda p: (p[0], -(p[2] if digits is None else round(p[2], digits)), p[1])):
        out.setdefault(x, (y, pytest.approx(s, abs=1e-5)))
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.58), (2, 0.35), (4, 0.95)])
def test_links_are_all_pairs_from_the_threshold_on(spark, seed, threshold):
    x = keyed(catalogue(spark, 130, seed)).cache()
    own = classes_of(x)
    links = group_links(own, own, threshold)
    found = x.select(F.col("id").alias("x"), "key").join(links, "key").join(members(x).withColumnRenamed("id", "y"), "group").filter("x != y")
    got = {(r["x"], r["y"]): r["score"] for r in found.groupBy("x", "y").agg(F.max("score").alias("score")).collect()}
    want = {(p["x"], p["y"]): p["score"] for p in all_pairs(x, x, threshold)}
    assert got.keys() == want.keys() != set() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("seed", [5])
def test_best_matches_and_clusters(spark, monkeypatch, seed):
    monkeypatch.setattr(matching, "SPLIT_ROWS", 5)
    rows = catalogue(spark, 120, seed).cache()
    pairs = [tuple(p) for p in all_pairs(rows, rows, 0.58)]
    got = best_after(rows, 0.58).collect()
    assert {r["id"]: (r["other"], r["score"]) for r in got} == best([p for p in pairs if p[0] < p[1]], 5) and len(got) == len({r["id"] for r in got})
    left, right = rows.filter("id % 3 = 0"), rows.filter("id % 3 != 0")
    assert {r["id"]: (r["other"], r["score"]) for r in best_of(left, right, 0.58).collect()} == best([p for p in pairs if p[0] % 3 == 0 and p[1] % 3])
    roots = {}
    for x, y, _ in pairs:  # the least id that links lead to, by repeated relabelling
        roots.setdefault(x, x)
        roots.setdefault(y, y)
    for _ in roots:
        for x, y, _ in pairs:
            roots[x] = roots[y] = min(roots[x], roots[y])
    got = clustered(rows, 0.58).collect()
    assert {r["id"]: (r["other"], r["score"]) for r in got} == best(pairs) and {r["id"]: r["root"] for r in got} == roots and len(got) == len(roots)


def test_no_records(spark):
    none = catalogue(spark, 20, 1).limit(0)
    assert best_after(none, 0.58).collect() == best_of(none, none, 0.58).collect() == clustered(none, 0.58).collect() == []


def test_thresholds_that_no_index_serves(spark):
    own = classes_of(keyed(catalogue(spark, 20, 1)))
    for threshold in (0.1, 1.5):
        with pytest.raises(ValueError, match="index"):
            group_links(own, own, threshold)


@pytest.mark.parametrize("least", [0.2, 0.636, 1.0])
def test_similar_sets(spark, monkeypatch, least):
    monkeypatch.setattr(matching, "KNOWN_TOKENS", 6)
    monkeypatch.setattr(matching, "SPLIT_ROWS", 7)
    draw = random.Random(int(least * 10))
    rows = [(i, f"k{i % 2}", draw.sample(WORDS, draw.randint(0, 7))) for i in range(160)]
    got = similar_sets(spark.createDataFrame(rows, "id long, k string, tokens array<string>"), ["k"], least).collect()
    want = {}
    for (i, k, a), (j, m, b) in itertools.combinations(rows, 2):
        if k == m and a and b and len({*a} & {*b}) >= least * len({*a} | {*b}) - 1e-9:
            want[i, j] = len({*a} & {*b}) / len({*a} | {*b})
    assert {(r["left"], r["right"]): r["jac"] for r in got} == pytest.approx(want) and len(got) == len(want) > 0


@pytest.mark.parametrize("at_least", [10, 10**6])
def test_next_after(spark, at_least):
    draw = random.Random(8)
    there = [("big" if draw.random() < 0.5 else f"k{draw.randrange(30)}", draw.choice([draw.randrange(2000), 1000])) for _ in range(800)]
    asks = [(draw.choice(["big", "big", *[f"k{i}" for i in range(32)]]), draw.randrange(-5, 2005), str(i)) for i in range(600)]
    got = nearest.next_after(spark.createDataFrame(asks, "key string, at long, name string"), spark.createDataFrame(there, "key string, at long"), "key", "at", at_least).collect()
    want = sorted((k, at, name, min((a for m, a in there if m == k and a > at), default=-1)) for k, at, name in asks)
    assert sorted((r["key"], r["at"], r["name"], -1 if r["next"] is None else r["next"]) for r in got) == want


def test_a_block_of_a_third_of_all_records_has_few_candidates(spark):
    """A third of 3,000 records in one block, a third of these copies, a third of one model: links stay a few a record."""
    draw = random.Random(9)
    word = lambda: f"w{int(draw.paretovariate(0.7)) % 3000}"
    rows = []
    for i in range(3000):
        title = "the same old vacuum here" if i % 9 == 0 else " ".join(word() for _ in range(8))
        rows.append((i, "hot" if i % 3 == 0 else f"b{i % 40}", title, "nv356" if i % 9 == 3 else None, [], 10.0 + i % 50))
    df = spark.createDataFrame(rows, "id long, brand string, title_norm string, model_no string, title_model_tokens array<string>, price double")
    r = F.struct("title_norm", "model_no", "title_model_tokens", "price", "brand", title_tokens(F.col("title_norm")).alias("tokens"), title_numbers(F.col("title_norm")).alias("numbers"))
    x = keyed(df.select("id", F.col("brand").alias("block"), r.alias("r"), F.lit(False).alias("exact"))).cache()
    own = classes_of(x)
    links = group_links(own, own, 0.58).count()
    hot = x.filter("block = 'hot'").count()
    assert hot == 1000 and links < 3 * own.count() + 50 * 50  # the copies have 50 prices
    assert best_after(x.drop("key"), 0.58).filter("id % 9 = 0").count() == 333


def test_components_of_text_nodes(spark):
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y")], "a string, b string")
    assert sorted(map(tuple, label_components(links).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_only_the_best_pairs_are_sent_on(spark, monkeypatch):
    """200 listings of one title at 200 prices: each asks once or twice, not once a listing like it."""
    r = F.struct(F.lit("old ring").alias("title_norm"), F.lit(None).cast("string").alias("model_no"), F.array().cast("array<string>").alias("title_model_tokens"), (100.0 + (F.col("id") * 37) % 200).alias("price"), F.lit("acme").alias("brand"), F.array(F.lit("old"), F.lit("ring")).alias("tokens"), F.array().cast("array<string>").alias("numbers"))
    rows = spark.range(200).select("id", F.lit("b").alias("block"), r.alias("r"), F.lit(False).alias("exact")).cache()
    sent, asks, first = [], matching.next_after, matching.first_rows
    monkeypatch.setattr(matching, "next_after", lambda requests, *a: sent.append(requests.count()) or asks(requests, *a))
    pairs = [tuple(p) for p in all_pairs(rows, rows, 0.58)]
    assert {r["id"]: (r["other"], r["score"]) for r in best_after(rows, 0.58).collect()} == best([p for p in pairs if p[0] < p[1]], 5)
    monkeypatch.setattr(matching, "first_rows", lambda df, *a: sent.append(df.count()) or first(df, *a))
    left, right = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    assert {r["id"]: (r["other"], r["score"]) for r in best_of(left, right, 0.58).collect()} == best([p for p in pairs if p[0] % 2 == 0 and p[1] % 2])
    assert len(sent) == 2 and sent[0] <= 400 and sent[1] == 100
