"""Monthly counts of a stream of reviews; the batch panel's semantics with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_reviews(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def windowed_counts(rows: DataFrame, at: str, keys: list[str], window: str = "30 days", late: str = "7 days") -> DataFrame:
    """Counts by key and window of event time; rows later than ``late`` are left out, as a stream must."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has arrived as Parquet and stop; a later call goes on from the checkpoint."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
