"""Substring search by an index of trigrams: a search reads the postings of a few trigrams and the texts that have them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import checkpointed, stored

#: Characters of texts whose postings are put together at once, unless one text alone has more.
BLOCK_CHARS = 1 << 22
#: Ids of a row of postings at most.
ROW_IDS = 1 << 16
#: Trigrams that a search intersects: the rarest of those it holds.
ASKED = 4


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text; none of shorter ones."""
    letters = F.split(F.lower(F.coalesce(c, F.lit(""))), "")
    runs = lambda a: F.when(F.size(a) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 3, F.lit(0))), lambda i: F.concat(a[i], a[i + 1], a[i + 2])))
    # the characters are an array that is bound once, so that a run costs the same anywhere in a text
    return F.array_distinct(F.flatten(F.array_compact(F.transform(F.array(letters), runs))))


def _block_postings(ids: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """gram, first, ids: the ids of the texts that hold each trigram, in rows of ``ROW_IDS`` at most."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    if len(chars) < 3:
        return
    letters, code = np.unique(chars, return_inverse=True)
    code, n = code.astype(np.int64), len(letters)
    runs = (code[:-2] * n + code[1:-1]) * n + code[2:]  # below 2**63: there are fewer than 2**21 characters
    inside = np.ones(len(runs), bool)
    for back in (1, 2):  # runs that begin one or two before the end of a text would go on into the next
        at = ends - back
        inside[at[(at >= 0) & (at < len(runs))]] = False
    text = np.repeat(np.arange(len(texts)), size)[:-2][inside]
    runs = runs[inside]
    if n**3 * len(texts) >= 1 << 62:
        known, runs = np.unique(runs, return_inverse=True)
    else:
        known = None
    pairs = np.unique(runs * len(texts) + text)
    runs, text = pairs // len(texts), pairs % len(texts)
    starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, np.int64)
    bounds = np.append(starts, len(runs))
    long = np.flatnonzero(np.diff(bounds) > ROW_IDS)
    if len(long):
        cuts = [np.arange(bounds[k], bounds[k + 1], ROW_IDS) for k in long]
        starts = np.unique(np.concatenate([starts, *cuts]))
        bounds = np.append(starts, len(runs))
    own = runs[starts] if known is None else known[runs[starts]]
    word = np.stack([letters[own // (n * n)], letters[own // n % n], letters[own % n]], 1).astype("<u4").tobytes().decode("utf-32-le")
    grams = [word[k : k + 3] for k in range(0, len(word), 3)]
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids[text]))
    for k in range(0, len(grams), 10_000):
        part = lists.slice(k, 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + 10_000], pa.string()), pa.array(ids[text[starts[k : k + 10_000]]]), part], ["gram", "first", "ids"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a task's texts (id, lower-cased text), block by block."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and held + len(text) > BLOCK_CHARS:
                yield from _block_postings(np.array(ids, np.int64), texts)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text)
    if texts:
        yield from _block_postings(np.array(ids, np.int64), texts)


def write_index(texts: DataFrame, path: str, parts: int = 200) -> None:
    """Write ``texts`` (id: long, text), ``postings`` (gram, first, ids) and ``counts`` (gram, n) to ``path``.

    A task puts the postings of a block of texts together, so that a row is a
    gram of a block with the ids of its texts, and far fewer rows than pairs of
    gram and text are dealt out. Postings are in order of gram and first id, so
    that the row groups that hold a gram are few and found by their statistics;
    a frequent gram goes over many files. Texts are in order of id for the
    same reason. Null ids and texts are left out.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col("id").cast("long").alias("id"), "text").filter("id is not null and text is not null")
    rows.repartitionByRange(parts, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/texts")
    kept = spark.read.schema(rows.schema).parquet(f"{path}/texts")
    kind = "gram string, first long, ids array<long>"
    grams = stored(kept.select("id", F.make_valid_utf8(F.lower("text")).alias("text")).mapInArrow(_postings, kind))  # the order's borders need it, too
    grams.repartitionByRange(parts, "gram", "first").sortWithinPartitions("gram", "first").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    counts = spark.read.schema(kind).parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
    counts.repartitionByRange(max(1, parts // 50), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def search(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """id, text of the texts that hold ``needle``, whatever its case and signs; an empty one is in all.

    The rarest trigrams of the needle are looked up, their postings are read by
    pushed filters and intersected, and only those texts are read and looked
    into. Needles under three characters, or with a case that changes their
    length, are looked for in all texts.
    """
    texts = spark.read.schema("id long, text string").parquet(f"{path}/texts")
    holds = F.contains(F.lower("text"), F.lower(F.lit(needle)))
    own = spark.range(1).select(trigrams(F.lit(needle)).alias("g")).first()["g"]  # of the needle alone
    if not own:
        return texts.filter(holds)
    counts = spark.read.schema("gram string, n long").parquet(f"{path}/counts").filter(F.col("gram").isin(own)).collect()  # at most the needle's trigrams
    known = {r["gram"]: r["n"] for r in counts}
    if any(g not in known for g in own):
        return texts.limit(0)
    asked = sorted(own, key=lambda g: (known[g], g))[:ASKED]
    postings = spark.read.schema("gram string, ids array<long>").parquet(f"{path}/postings").filter(F.col("gram").isin(asked))
    ids = postings.select("gram", F.explode("ids").alias("id"))  # an id may have several texts.groupBy("id").agg(F.size(F.collect_set("gram")).alias("n")).filter(F.col("n") == len(asked)).select("id")
    ids = checkpointed(ids)
    span = ids.agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return texts.limit(0)
    near = texts.filter(F.col("id").between(span["a"], span["z"]))
    if span["n"] <= 1000:
        near = near.filter(F.col("id").isin([r["id"] for r in ids.collect()]))  # a bounded list, which prunes row groups
        return near.filter(holds)
    return near.join(ids, "id", "left_semi").filter(holds)
