"""Named queries that run as streams over the tables' files, as many as have arrived, and return what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import new_folder
from ..sources.readers import read_table
from ..streaming.low_ratings import STORE, STORE_CONF, low_rating_stream
from ..streaming.panels import run_available
from ..streaming.upsert import keep_best
from .event_queries import LAST, STUDY_SQL
from .registry import query


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The files of a table as a stream; all that are there make one batch, since tables aren't in order of time."""
    return spark.readStream.schema(read_table(spark, d, name).schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{d}/{name}.parquet*")


def with_store(spark: SparkSession, run) -> None:
    """Run a stream with the state store that typed state needs; the session's own setting comes back."""
    old = spark.conf.get(STORE_CONF, None)
    spark.conf.set(STORE_CONF, STORE)
    try:
        run()
    finally:
        spark.conf.unset(STORE_CONF) if old is None else spark.conf.set(STORE_CONF, old)


@query("stream_dedup", "SELECT doc_id, md5(text) AS text_md5, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream, merged into a table of the best of each text."""
    docs = stream_of(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")
    table = new_folder(spark, "best")
    keep_best(docs, table, new_folder(spark, "check"), ["text_md5"], lambda: [F.col("n_chars").desc(), F.col("doc_id")])
    return spark.read.schema("doc_id long, text_md5 string, lang string, n_chars long, bucket int").parquet(table).select("doc_id", "text_md5", "lang")


@query("stream_low_ratings", STUDY_SQL + "SELECT unit, CAST(m0 AS INT) AS m0 FROM fired")
def stream_low_ratings(spark: SparkSession, d: str) -> DataFrame:
    """The event study's low ratings from a stream of reviews: brands' months, closed by timers."""
    line = stream_of(spark, d, "lineitem").filter("l_returnflag != 'R'")
    part, orders = read_table(spark, d, "part").select("p_partkey", "p_brand"), read_table(spark, d, "orders").select("o_orderkey")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.col("l_shipdate").cast("date").cast("timestamp").alias("at")
    reviews = rows.select(F.col("p_brand").alias("unit"), at, (F.floor((F.col("l_quantity") - 1) / 10).cast("int") + 1).alias("rating"))
    out = new_folder(spark, "low")
    with_store(spark, lambda: run_available(low_rating_stream(reviews, LAST), out, new_folder(spark, "check")))
    return spark.read.schema("unit string, m0 int").parquet(out)
