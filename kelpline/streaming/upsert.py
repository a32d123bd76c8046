"""Deduplication of streams: repeats inside a watermark, and the best row a key kept in a table that batches are merged into."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.relational import checkpointed, first_rows


def distinct_within(rows: DataFrame, at: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of each key, for as long as ``late`` behind the watermark; state older than that goes."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def merge_best(batch: DataFrame, path: str, keys: Sequence[str], order: Callable[[], Sequence[Column]], buckets: int = 64) -> None:
    """Merge ``batch`` into the table at ``path``, which holds the first row of each key by ``order``, a total order.

    The table is partitioned by a hash of the keys into ``buckets``. Only buckets
    that the batch has rows for are read and replaced. The result depends on the
    rows alone: a batch that is merged again, wholly or after a failure
    between buckets, changes nothing.
    """
    spark = batch.sparkSession
    new = first_rows(batch, keys, order()).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    new = checkpointed(new)
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    if not touched:
        return
    try:
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
        rows = first_rows(old.unionByName(new), [*keys, "bucket"], order())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = new
    rows = checkpointed(rows)  # the files that are read are replaced below
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def keep_best(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Callable[[], Sequence[Column]], buckets: int = 64) -> StreamingQuery:
    """Merge what has arrived of a stream into the table at ``path`` and stop; a later call goes on from the checkpoint."""
    query = rows.writeStream.foreachBatch(lambda batch, _: merge_best(batch, path, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
