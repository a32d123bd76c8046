"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters.

Documents are range-partitioned and sorted by id, encoded, and written by
Spark's ORC writer: ids are an integer list column, which ORC stores in
run-length encoded streams cut into stripes; each stripe has a row index and a
Bloom filter on the document id. Readers split files at stripes, and a filter
on the id prunes files, stripes and row groups from metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, written
from .word_encoder import encoder, slices

#: Bytes of texts that are encoded at once: the more, the fewer distinct words are looked up again.
AT_ONCE = 8 << 20
#: Writer options; sizes in bytes. Fixed values of the file format's own names.
ORC_OPTIONS = {
    "compression": "snappy",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        texts = batch.column(1)
        for lo, hi in slices(texts, AT_ONCE):
            ids, ends = enc.encode_flat(texts.slice(lo, hi - lo).to_pylist(), [end_id])
            for a, b in _cuts(ends):
                lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(ids[ends[a] : ends[b]].view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a), lists], ["doc_id", "ids"])


def _cuts(ends: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` ids at most, so that no Arrow batch is large."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def write_token_orc(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` and write ORC files in ascending id order to ``out``.

    Files are numbered in id order and sorted inside. Null texts have only the
    end id; null ids sort first; repeated ids are all kept, in an order by their
    texts' hashes, so that an id with many texts is no single range; other
    columns are ignored. An empty table writes files without rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("by"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc(), F.col("by").asc()).sortWithinPartitions("doc_id", "by")
    ids = ordered.select("doc_id", "text").mapInArrow(lambda it: _encode_batches(it, tokenizer_path, end_id), "doc_id long, ids array<int>")
    ids.write.mode("overwrite").options(**ORC_OPTIONS).orc(out)
    return out


def read_token_orc(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Rows of the files at ``path``: doc_id, ids. ``where`` is pushed to the stripes' statistics and Bloom filters."""
    rows = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return rows if where is None else rows.filter(where)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their count and checksum of ids, and their number in this task, which reads each block in order."""
    seen = 0
    for batch in batches:
        lists = batch.column(3)
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        own = [*batch.columns[:3], pa.array(range(seen, seen + batch.num_rows), pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(own, ["doc_id", "file", "block", "nth", "n_tokens", "ids_crc32"])
        seen += batch.num_rows


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in the files' own order.

    ``start`` is a sum in two steps, inside each file and over the files'
    totals, so no task sees more than a file's rows or one row a file.
    """
    file = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("long").alias("file")
    rows = read_token_orc(spark, path).select("doc_id", file, F.col("_metadata.file_block_start").alias("block"), "ids")
    rows = written(rows.mapInArrow(_digest, "doc_id long, file long, block long, nth long, n_tokens long, ids_crc32 long"), "digest")
    inside = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    over = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("before"))
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(totals, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Write ``docs`` to ORC and return the digest of what the files hold."""
    spark = docs.sparkSession
    return token_offsets(spark, write_token_orc(docs, out or new_path(spark, "tokens"), tokenizer_path, end_id))
