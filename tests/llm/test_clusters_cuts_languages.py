"""Clustering, fill-in-the-middle and language identification against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import language_id, weighted_kmeans
from kelpline.llm.fill_in_middle import DELIMITER, ESCAPE, fill_in_middle, marked, restored, unmarked
from kelpline.llm.language_id import identify, is_held_out, letters, train_languages
from kelpline.llm.queries import op12_fill_in_middle, op13_naive_bayes_language
from kelpline.llm.weighted_kmeans import cluster_vectors

VECTORS = "vec_id long, embedding array<double>, cluster string, q int, key string, weight long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, form int, n string, held_out string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "k", 2) for i, v in rows], VECTORS)


def lloyd(rows, k, rounds, scale, width, seed):
    """Every kept row by itself, in Python's whole numbers."""
    kept = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(x * scale))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))[::-1]
    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        for n in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            centroids[n] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    most = (1 << 63) - 1
    spread = {n: min(most, sum(d for _, o, d in last if o == n)) for n in {o for _, o, _ in last}}
    every = min(most, sum(d for _, _, d in last))
    return sorted(((i, n, min(d, most), spread[n], min(every, most), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in last), key=repr)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize(("k", "partitions"), [(1, 1), (4, 3), (16, 7)])
def test_clusters(spark, k, partitions):
    draw = np.random.default_rng(k)
    rows = [(i, [float(x) for x in draw.normal(size=3).round(1)]) for i in range(300)]
    rows += [(i, [0.25, -0.25, 0.0]) for i in range(300, 500)] + [(7, [9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [1.0, float("inf"), 2.0]), (906, [0.0] * 4), (907, [-0.0, 0.0, 1e-9])]
    df = cluster_vectors(vectors(spark, rows).repartition(partitions), k=k, rounds=3, scale=64, width=3)
    assert got(df) == lloyd(rows, k, 3, 64, 3, 1)


def test_clusters_join_frequent_vectors_by_broadcast(spark):
    rows = [(i, [float(i % 5), 0.5] if i % 3 else [0.125, 0.125]) for i in range(3000)] + [(3000 + i, [i / 64, -i / 64]) for i in range(1500)]
    df = cluster_vectors(vectors(spark, rows), k=5, rounds=2, scale=64, width=2, seed=4)
    assert got(df) == lloyd(rows, 5, 2, 64, 2, 4)


def test_clusters_of_large_components_are_exact(spark):
    rows = [(0, [1e17, -1e17]), (1, [1e17 + 64, -1e17]), (2, [0.0, 3.0]), (3, [1e300, 0.0]), (4, [-1e300, 5.0]), (5, [2.0**40, 7.0]), (6, [2.0**40, 7.0])]
    for k in (2, 4):
        assert got(cluster_vectors(vectors(spark, rows), k=k, rounds=3, scale=64, width=2)) == lloyd(rows, k, 3, 64, 2, 1)


def test_clusters_of_few_and_no_vectors(spark):
    few = [(2, [1.0]), (1, [2.0])]
    assert got(cluster_vectors(vectors(spark, few), width=1)) == lloyd(few, 16, 3, 64, 1, 1)
    for rows in ([], [(1, None), (2, [1.0])]):
        df = cluster_vectors(vectors(spark, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_distances_go_to_the_smaller_cluster():
    v, c = np.array([[0, 0]]), np.array([[3, 4], [4, 3], [5, 0]])
    for scale in (1, 1 << 40):
        assert weighted_kmeans.distances(v * scale, c * scale).argmin(axis=1).tolist() == [0]


TEXTS = [None, "", "a", "ab cd", "a\nb\r\n\t c", "ÄÖ x́ \U0001f600y", f"{ESCAPE}0{ESCAPE}1{DELIMITER}{ESCAPE}", f"a{DELIMITER}b{ESCAPE}c{ESCAPE}{ESCAPE}01", "has <P> in it", "x<S>", "<M>", "<", "<<S", "a<P", "\\1 $0 \\ $", "word, " * 20_000, "Z" * 300_000, "same", "same"]


def cut(doc_id, text):
    """n, form, prefix, middle, suffix, output by the definition."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, p, m, s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle(spark):
    rows = [(7 * j + i * 100, t) for j in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (5, "twice two"), (5, "twice two")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 3, "clash", "clash") for i, t in rows], DOCS)
    made = fill_in_middle(df)
    found = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r["doc_id"], *r[1:7]) for r in found), key=repr) == sorted(((i, *cut(i, t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["back"]) for r in found), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).collect() == []


def test_fill_in_middle_has_no_python_and_no_shuffle(spark, data):
    plan = op12_fill_in_middle(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_marks_can_be_undone(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "t string").select("t", unmarked(marked(F.col("t"))).alias("u"))
    assert all(r["t"] == r["u"] for r in df.collect())


def naive(rows, bits):
    """The model's counts and a score of a text by the definition, gram by gram."""
    mask = (1 << 64) - 1

    def buckets(text):
        plain = letters(text)
        for n in (1, 2, 3):
            for at in range(len(plain) - n + 1):
                h = n
                for c in plain[at : at + n]:
                    h = (h + ord(c)) * 0x9E3779B97F4A7C15 & mask
                yield (h ^ (h >> 29)) * 0xC2B2AE3D27D4EB4F % (1 << 64) >> (64 - bits)

    known = [(t, lang) for t, lang in rows if lang is not None]
    langs = sorted({lang for _, lang in known})
    counts = {lang: np.full(1 << bits, 0.5) for lang in langs}
    for t, lang in known:
        for b in buckets(t):
            counts[lang][b] += 1
    prior = {lang: sum(x == lang for _, x in known) / len(known) for lang in langs}

    def told(text):
        if not letters(text) or not langs:
            return "und", 0.0
        logs = [math.log(prior[x]) + sum(math.log(counts[x][b] / counts[x].sum()) for b in buckets(text)) for x in langs]
        best = max(range(len(langs)), key=lambda k: (logs[k], -k))
        return langs[best], 1 / sum(math.exp(x - logs[best]) for x in logs)

    return told


SPOKEN = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("Straße ÄÖÜ", "de"), ("", "en"), (None, "fr"), ("12 34!", "en"), ("the the the", None), ("日本語", "ja"), ("twice", "en"), ("twice", "en")]
ASKED = ["the cat", "die katze", "le chat", "日本", "", None, "123 ,.", "x", "ö", "THE DOG!!", "_ _", "\U0001f600", "² ½Ⅷ", "x²the½", "the dog and die katze " * 40]


@pytest.mark.parametrize("at_once", [5, 1 << 18])
def test_languages_by_the_definition(spark, monkeypatch, at_once):
    monkeypatch.setattr(language_id, "AT_ONCE", at_once)
    df = lambda rows: spark.createDataFrame([(i, t, lang, "s", 1, "clash", 3, "clash", "h") for i, (t, lang) in enumerate(rows)], DOCS)
    model = train_languages(df(SPOKEN).repartition(3), bits=8)
    told = naive(SPOKEN, 8)
    rows = identify(df([(t, "zz") for t in ASKED]), model, ["doc_id", "held_out"]).collect()
    for r, (lang, sure) in zip(sorted(rows), map(told, ASKED), strict=True):
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(sure, abs=1e-3) and r["held_out"] == "h"


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None, "s", 1, "x", 3, "y", "h"), (None, None, None, None, None, None, None, None, None)], DOCS)
    for part in (df, df.limit(0)):
        model = train_languages(part)
        assert [tuple(r) for r in identify(df, model, ["doc_id"]).orderBy("doc_id").collect()] == [(None, "und", 0.0), (1, "und", 0.0)]
    assert identify(df.limit(0), train_languages(df), ["doc_id"]).collect() == []


def test_many_languages_share_a_bounded_matrix(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELL_BITS", 12)
    df = spark.createDataFrame([(i, chr(97 + i % 26) * 3 + chr(97 + i // 26) * 3, f"l{i:03}", "s", 1, "x", 3, "y", "h") for i in range(100)], DOCS)
    model = train_languages(df)
    assert len(model.languages) == 100 and model.by_bucket.size <= 1 << 12
    assert identify(df, model, ["doc_id", "lang"]).filter("lang = lang_pred").count() > 40
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 99)
    with pytest.raises(ValueError, match="more than 99"):
        train_languages(df)


def test_held_out_languages_are_told(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = op13_naive_bayes_language(spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    # Labels of held-out rows, and all sources and ids' order, make no difference.
    other = docs.withColumn("lang", F.when(is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other")).repartition(5)
    other.write.parquet(f"{tmp_path}/documents.parquet")
    again = op13_naive_bayes_language(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in again} == {r["doc_id"]: r["lang_pred"] for r in rows}
