"""Readers with explicit schemas, and the tables that analyses are bound to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import AGE_BANDS
from ..functions.dates import banded, months_between

REVIEW = "user_id string, parent_asin string, asin string, timestamp long, rating double, verified_purchase boolean, helpful_vote long, title string, text string"
META = (
    "parent_asin string, title string, store string, main_category string, average_rating double, rating_number long, price string, categories array<string>, "
    "features array<string>, description array<string>, details map<string, string>, comparator_brand string"
)


class SourceError(Exception):
    """A table or file that isn't there."""


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a directory; any file system that Spark reads."""
    path = f"{directory}/{name}.parquet"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceError(f"no table {name} in {directory}") from e
        raise


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; malformed lines become null rows. A gzip file is one task, so its rows are dealt out anew."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines as column ``value``, for passing records through unparsed."""
    return spark.read.text(path)


def lines_of(lines: DataFrame, ids: DataFrame, field: str = "parent_asin") -> DataFrame:
    """The raw lines (column ``value``) whose first ``field`` is one of ``ids`` (first column), unparsed and unchanged; Spark broadcasts ids only where they are small."""
    keys = ids.select(ids[0].cast("string").alias("_id")).distinct()
    key = F.regexp_extract("value", rf'"{field}"\s*:\s*"([^"]*)"', 1)
    return lines.join(keys, key == F.col("_id"), "left_semi")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def register(spark: SparkSession, directory: str, names: list[str], prefix: str = "") -> None:
    """Temporary views of a directory's tables."""
    for name in names:
        read_table(spark, directory, name).createOrReplaceTempView(prefix + name)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def clean_reviews(raw: DataFrame, launches: DataFrame) -> DataFrame:
    """Typed reviews of raw ones, with the flag of those before the listing's launch (parent_asin, launch_date)."""
    at = F.timestamp_millis(F.col("timestamp"))
    day = at.cast("date")
    rows = raw.select(
        F.md5(F.concat_ws("|", "user_id", "parent_asin", F.col("timestamp").cast("string"), F.md5(F.coalesce("text", F.lit(""))))).alias("review_id"), "parent_asin", "asin",
        (F.col("asin") != F.col("parent_asin")).alias("is_variant_asin"), at.alias("review_ts"), day.alias("review_date"), F.trunc(day, "MM").alias("review_month"),
        F.col("rating").cast("tinyint").alias("rating"), "verified_purchase", "helpful_vote", "user_id", F.col("title").alias("review_title"),
        F.nullif(F.trim("text"), F.lit("")).alias("review_text"),
    )
    return rows.join(launches, "parent_asin", "left").withColumn("before_launch", F.coalesce(F.col("review_date") < F.col("launch_date"), F.lit(False))).drop("launch_date")


def units(spark: SparkSession, directory: str) -> DataFrame:
    """Catalogue units: part as listing."""
    part = read_table(spark, directory, "part")
    own = F.when(F.substring("p_brand", 7, 10).cast("int") <= 12, "Own").otherwise("Peers")
    return part.select(F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("product_type"), F.col("p_retailprice").alias("price"), own.alias("brand_set"))


def raw_reviews(spark: SparkSession, directory: str) -> DataFrame:
    """Reviews: lineitem with its order's date."""
    line, orders = read_table(spark, directory, "lineitem"), read_table(spark, directory, "orders")
    day = F.col("l_shipdate").cast("date")
    rows = line.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", day.cast("string"))).alias("review_id"), F.col("l_partkey").alias("unit_id"), day.alias("review_date"),
        (F.floor((F.col("l_quantity") - 1) / 10).cast("int") + 1).alias("rating"), (F.col("l_linestatus") == "F").alias("verified"),
        F.when(F.col("l_returnflag") == "R", "refurbished").otherwise("new").alias("channel"), F.col("o_orderdate").cast("date").alias("order_date"),
        (F.col("l_shipdate") < F.col("o_orderdate")).alias("before_launch"), F.col("l_quantity").alias("months"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("helpful"),
    )


def reviews(spark: SparkSession, directory: str, rows: DataFrame | None = None) -> DataFrame:
    """The fact that all analyses share: reviews (``rows``, or else all raw ones) with their unit, age in months, year, low flag and age band.

    The launch comes from a window over the unit, so that the reviews are read and
    dealt out by unit once, and not at all for it where no age is asked for.
    """
    rows = raw_reviews(spark, directory) if rows is None else rows
    rows = rows.withColumn("launch_date", F.min("review_date").over(Window.partitionBy("unit_id")))
    age = F.greatest(F.lit(0), months_between(F.col("launch_date"), F.col("review_date")))
    rows = rows.join(units(spark, directory), "unit_id")
    return rows.withColumn("age_m", age).withColumns({"yr": F.year("review_date"), "low": (F.col("rating") <= 2).cast("int"), "age_band": banded(F.col("age_m"), AGE_BANDS)})
