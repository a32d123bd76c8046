"""A corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.best_two_fit import pack_documents
from kelpline.llm.common import written
from kelpline.llm.ngram_join import ngram_join
from kelpline.llm.positional_index import find_contamination
from kelpline.llm.quality import score, train
from kelpline.llm.queries import GOOD_FROM
from kelpline.llm.secret_forest import redact_secrets, train_forest
from kelpline.llm.word_encoder import vocabulary


def whole(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that the stages' own names can't clash with theirs, whatever their names and types."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is good; the rest go. Columns of any name and type come out as they are."""
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("text", whole(docs)), weights, ["_row"])
    return scored.filter(F.col("score") >= GOOD_FROM).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 of their five-word shingles, the one with the least id.

    Rows that repeat both id and text count once: the one whose other columns
    come first as JSON stays. Rows are told apart by id and text together: one
    without id stays only where no similar one has an id. Columns of any name
    and type come out as they are.
    """
    others = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(F.lit(0).alias("_"), *others))
    one = docs.select(F.xxhash64("doc_id", "text").alias("_key"), order.alias("_order"), whole(docs)).groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    rows = written(one, "rows")
    groups = ngram_join(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), n=5, num=80, den=100)
    group_of = rows.select("_key", F.struct(F.col("_row.doc_id").isNull().alias("none"), F.col("_row.doc_id").alias("id"), F.col("_key").alias("key")).alias("_id")).join(groups.select(F.col("doc_id").alias("_key"), "component_id"), "_key")
    least = written(group_of.groupBy("component_id").agg(F.min("_id")["key"].alias("_key")).select("_key"), "least")
    return rows.join(least, "_key", "left_semi").select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; each text is judged by itself, whatever its row's id. Columns of any name and type come out as they are."""
    key = F.xxhash64("text")
    found = find_contamination(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = written(found.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.select(key.alias("_key"), whole(docs)).join(hit, "_key", "left_anti").select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind, and ``n_chars`` set right where there is such a column."""
    others = [c for c in docs.columns if c != "text"]
    path = ["source"] if "source" in others else []
    rest = F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row")
    clean = redact_secrets(docs.select("text", *path, rest), train_forest())
    own = {"text": F.col("text")}
    if "n_chars" in others:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*(own.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: SQL cannot express the stages: a trained classifier, a random forest, a tokenizer. Tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
