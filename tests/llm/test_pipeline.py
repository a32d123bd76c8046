"""The pipeline's stages against brute force on a small corpus, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kelpline.llm.quality import score, train


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, data, docs):
    from test_operators import brute_groups

    weights = train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = corpus_pipeline.quality(spark, docs, data)
    assert ids(good) == ids(score(docs, weights, ["doc_id"]).filter("score >= 0.3")) and good.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in good.union(good.limit(3)).collect()]
    unique = corpus_pipeline.near_duplicates(spark, good.union(good.limit(3)), data)
    assert ids(unique) == sorted({c for _, n, c in brute_groups(rows, 5, 80, 100)}) and unique.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, unique, data)
    assert set(ids(clean)) <= set(ids(unique)) and clean.columns == docs.columns
    masked = corpus_pipeline.secrets(spark, clean, data)
    assert ids(masked) == ids(clean) and masked.columns == docs.columns and masked.filter("n_chars != length(text)").count() == 0
    assert masked.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    packed = corpus_pipeline.pack(spark, masked, data)
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids(masked)


def test_verdicts_go_with_the_text(spark, data, docs):
    bad = next(r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 12)
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    rows = [(1, bad), (1, one), (None, bad), (None, two), (2, one), (None, one), (None, two), (3, two), (4, "z " + one), (5, None), (None, "")]
    made = spark.createDataFrame([tuple({"doc_id": i, "text": t, "n_chars": len(t or "")}.get(c) for c in docs.columns) for i, t in rows], docs.schema)
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    clean = corpus_pipeline.decontaminate(spark, made, data)
    assert left(clean) == sorted((r for r in rows if r[1] != bad), key=str)
    assert left(corpus_pipeline.near_duplicates(spark, made, data)) == sorted([(1, bad), (1, one), (3, two), (5, None), (None, "")], key=str)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=lambda f: f.__name__)
def test_columns_of_any_name_and_type_come_out_as_they_are(spark, data, docs, stage):
    """Names that the stages use themselves, odd names, maps and structs, and no n_chars."""
    extra = {
        "score": F.lit("s"), "_key": F.col("doc_id") * 2, "_row": F.lit(3), "_text": F.lit("t"), "component_id": F.lit(-1), "_order": F.lit("o"), "label": F.lit(1.5), "by": F.lit("b"), "a b.c": F.lit("odd"),
        "m": F.create_map(F.lit("k"), F.col("doc_id")), "st": F.struct(F.col("doc_id").alias("x y"), F.lit("z").alias("q")), "none": F.lit(None).cast("string"),
    }
    made = docs.filter("doc_id < 60").drop("n_chars").withColumns(extra)
    made = made.union(made.filter("doc_id < 5"))
    got = stage(spark, made, data)
    assert got.columns == made.columns and [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in made.schema]
    rows = {r["doc_id"]: r for r in made.collect()}
    kept = got.collect()
    assert kept and all(r[c] == rows[r["doc_id"]][c] for r in kept for c in made.columns if c != "text" or stage is not corpus_pipeline.secrets)


def test_run_of_empty_documents(spark, data, docs, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_", {"doc_id", "held_out", "score", "predicted"}), ("op3_", {"query_id", "rank", "vec_id", "score"}), ("op4_", {"page_id", "url", "text", "n_chars"}),
        ("op5_", {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}), ("op6_", {"doc_id", "n_shingles", "component_id"}),
        ("op7_", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}), ("op8_", {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}),
        ("op9_", {"doc_id", "start", "n_tokens", "ids_crc32"}), ("op10_", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}),
        ("op11_", {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}), ("op12_", {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"}),
        ("op13_", {"doc_id", "held_out", "lang_pred", "score"}),
    ],
)
def test_columns(spark, data, name, columns):
    query = next(f for n, f in entry.queries().items() if n.startswith(name))
    assert columns <= set(query(spark, data).columns)
