"""Centroid clustering of weighted distinct vectors.

Vectors are quantised to integers; equal ones become one row with a weight, so
a vector that a third of all rows share costs as much as any other. Lloyd's
rounds run over these rows: each task assigns its rows to the nearest centroid
and returns a row of weighted integer sums a cluster, which are added up before
and after a shuffle of at most ``k`` rows a task. All arithmetic is in whole
numbers, so results don't depend on partitions. At the end assignments are
joined back to the ids by a digest of the vector: those of at most
``1 / HEAVY_SHARE`` very frequent vectors by broadcast, the rest by shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Vectors of at least this share of all rows are joined by broadcast; there can't be more than 1024 of them.
HEAVY_SHARE = 1 / 1024
#: Components up to this size have squared distances below 2^53, which float64 products hold exactly.
EXACT_IN_FLOAT = 1 << 20
LARGEST = (1 << 63) - 1
ASSIGNED = "key binary, weight long, cluster int, distance long"


def quantised(c: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, taken as double; beyond 64 bits the nearest integer that fits."""
    return F.transform(c, lambda x: F.floor(x.cast("double") * float(scale)))


def usable(c: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, none of them null or non-finite."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(c) == width) & F.forall(c, lambda x: F.coalesce(whole(x.cast("double")), F.lit(False))), F.lit(False))


def digest(q: Column) -> Column:
    """32 bytes that stand for a quantised vector."""
    return F.unhex(F.sha2(F.array_join(q.cast("array<string>"), ","), 256))


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` from each centroid: int64, or Python integers where values are large."""
    large = max((int(abs(int(a.min(initial=0)))) if a.min(initial=0) < -a.max(initial=0) else int(a.max(initial=0)) for a in (v, centroids)), default=0)
    if large <= EXACT_IN_FLOAT:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    x, c = v.astype(object), centroids.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a cluster: weight and weighted sums of the task's rows that are nearest to it."""
    k, width = centroids.shape
    total, n = np.zeros((k, width), object), [0] * k
    for batch in batches:
        v, w = _vectors(batch, "q", width), batch.column("weight").to_numpy()
        near = distances(v, centroids).argmin(axis=1)
        small = len(v) == 0 or (int(w.sum()) * int(max(abs(int(v.min())), abs(int(v.max())), 1)) <= LARGEST)
        for c in np.unique(near):
            own = near == c
            part = v[own] * w[own, None] if small else v[own].astype(object) * w[own, None].astype(object)
            total[c] += part.sum(axis=0).astype(object)
            n[c] += int(w[own].sum())
    used = [c for c in range(k) if n[c]]
    kind = pa.decimal128(38, 0)
    arrays = [pa.array(used, pa.int32()), pa.array([n[c] for c in used], pa.int64()), pa.array([[int(x) for x in total[c]] for c in used], pa.list_(kind))]
    yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", "sums"])


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = distances(_vectors(batch, "q", centroids.shape[1]), centroids)
        near = d.argmin(axis=1)
        own = [min(int(x), LARGEST) for x in d[np.arange(len(d)), near]]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("weight"), pa.array(near.astype(np.int32)), pa.array(own, pa.int64())], ["key", "weight", "cluster", "distance"])


def lloyd_round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of weighted means; one without vectors stays as it is."""
    width = centroids.shape[1]
    kind = "decimal(38,0)"
    parts = distinct.select("q", "weight").mapInArrow(lambda it: _sums(it, centroids), f"cluster int, n long, sums array<{kind}>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]).cast(kind) for i in range(width))).alias("sums"))
    new = centroids.copy()
    for row in added.collect():  # at most a row a centroid
        new[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    return new


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the least sha256 of ``seed:id``; of equal ones the least vector comes first."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(by.alias("by"), "q").orderBy("by", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def cluster_vectors(embeddings: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Columns ``vec_id`` and ``embedding`` are read, others don't matter. Vectors
    that are null, of another width or hold a null or non-finite component take
    no part. Rows that repeat an id each count and come out once each; a null id
    counts as empty text where the first centroids are drawn. Of equal distances
    the smaller cluster number wins. With fewer vectors than ``k`` each is a
    centroid; without any the result is empty. A component beyond 64 bits counts
    as the nearest integer that fits, and sums of distances that don't fit are
    the largest long.
    """
    spark = embeddings.sparkSession
    rows = embeddings.filter(usable(F.col("embedding"), width)).select("vec_id", quantised(F.col("embedding"), scale).alias("q"))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    distinct = written(rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight")).withColumn("key", digest(F.col("q"))), "distinct-vectors")
    for _ in range(rounds):
        centroids = lloyd_round(distinct, centroids)
    assigned = written(distinct.select("key", "weight", "q").mapInArrow(lambda it: _assign(it, centroids), ASSIGNED), "assigned")
    drop_written(distinct)
    spread = assigned.groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(F.col("weight").cast("decimal(20,0)") * F.col("distance")).alias("inertia")).collect()  # at most a row a centroid
    total, every = sum(r["n"] for r in spread), min(sum(int(r["inertia"]) for r in spread), LARGEST)
    told = [(r["cluster"], min(int(r["inertia"]), LARGEST), every, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in spread]
    clusters = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # at most k rows
    frequent = F.col("weight") >= max(1.0, total * HEAVY_SHARE)
    heavy = F.broadcast(assigned.filter(frequent & (F.lit(total) > 1 / HEAVY_SHARE)).select("key", "cluster", "distance"))  # at most 1024 rows
    keyed = rows.select("vec_id", digest(F.col("q")).alias("key"))
    rest = keyed.join(heavy.select("key"), "key", "left_anti").join(assigned.select("key", "cluster", "distance"), "key")
    found = keyed.join(heavy, "key").unionByName(rest)
    return found.join(clusters, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
