"""Exact top-k search by aggregation without random access.

Vectors are packed into blocks. In a block each dimension is a list of its
components in sorted order; a query reads list d from the high end where its
own component is positive and from the low end where it is negative, all lists
to the same depth. What it has read gives bounds of every vector's score: a
component read counts itself; one not yet read lies between the end of the list
and the value at the reading depth. Vectors whose upper bound is below the k-th
best lower bound can't qualify; lists are read deeper until so few are left as
could qualify by ties, or to their ends, and only those are resolved. The bounds of a block of queries are two
matrix products, as max(v, depth value) and v-if-read stand for the lists.

Queries are a stated set, all of which meet all blocks: packed query blocks are
dealt to the groups of candidate blocks by an equi-join on the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a candidate block and in a query block.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Candidate blocks that share one copy of the queries.
BLOCKS_A_GROUP = 4
#: Queries whose bounds are held at once.
AT_ONCE = 64
#: Lists are read by this share more at a time.
DEEPER = 0.125
PACKED = "n int, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def _pack(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ids and scaled, floored components; vectors with a null or non-finite component take no part."""
    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []
    held, width = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ids, vectors, held
        own, rows = np.concatenate(ids), np.concatenate(vectors)
        for at in range(0, len(own), size):
            part = rows[at : at + size]
            yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([own[at : at + size].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())], ["n", "ids", "vectors"])
        ids, vectors, held = [], [], 0

    for batch in batches:
        lists = batch.column(1)
        rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), lists.to_pylist(), strict=True) if i is not None and v is not None and None not in v]
        if not rows:
            continue
        width = width or len(rows[0][1])
        if any(len(v) != width for _, v in rows):
            raise ValueError("vectors differ in length")
        x = np.array([v for _, v in rows], np.float64)
        good = np.isfinite(x).all(axis=1)
        ids.append(np.array([i for i, _ in rows], np.int64)[good])
        vectors.append(np.floor(x[good] * scale).astype(np.int64))
        held += int(good.sum())
        if held >= 4 * size:
            yield from flush()
    if held:
        yield from flush()


class Lists:
    """A block's sorted lists, and the parts of bounds that all queries share, by depth."""

    def __init__(self, v: np.ndarray, kind: type):
        self.v, self.kind, self.lists = v, kind, np.sort(v, axis=0)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        if depth not in self.known:
            v, lists = self.v, self.lists
            low, high = lists[depth - 1], lists[len(v) - depth]
            upper = np.concatenate([np.maximum(v, high), np.minimum(v, low)], axis=1)
            lower = np.concatenate([np.where(v >= high, v, lists[0]), np.where(v <= low, v, lists[-1])], axis=1)
            self.known[depth] = upper.astype(self.kind).T, lower.astype(self.kind).T
        return self.known[depth]

    def left(self, part: np.ndarray, alive: np.ndarray, k: int, least_score: int) -> tuple[np.ndarray, int]:
        """(vectors that may be among each query's ``k`` best, depth read). alive: those that may at the start."""
        n, depth = len(self.v), 0
        signed = np.concatenate([np.maximum(part, 0), np.minimum(part, 0)], axis=1).astype(self.kind)
        while depth < n and (alive.sum(axis=1) > k).any():
            depth = min(n, depth + max(1, int(n * DEEPER)))
            upper, lower = self.bounds(depth)
            cols = np.flatnonzero(alive.any(axis=0))
            lower_of = np.where(alive[:, cols], signed @ lower[:, cols], least_score)
            floor = np.partition(lower_of, len(cols) - k, axis=1)[:, len(cols) - k]
            alive = alive.copy()
            alive[:, cols] &= (signed @ upper[:, cols]) >= floor[:, None]
        return alive, depth


def block_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) of each query's ``k`` best in one block, ties to the smaller id."""
    largest = int(np.abs(v).max(initial=0)) * int(np.abs(q).max(initial=0)) * v.shape[1]
    if largest >= 1 << 53:
        kind: type = np.int64
    else:
        kind = np.float32 if largest < 1 << 24 else np.float64  # sums are exact in either
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    n = len(ids)
    lists = Lists(v, kind)
    out = []
    exact = v.astype(kind)
    for at in range(0, len(q), AT_ONCE):
        part, names = q[at : at + AT_ONCE], q_ids[at : at + AT_ONCE]
        alive = ids[None, :] != names[:, None]
        if n > 4 * k:
            alive, _ = lists.left(part, alive, k, -largest - 1)
        for r in range(len(part)):
            left = np.flatnonzero(alive[r])
            scores = exact[left] @ part[r].astype(kind)
            if len(left) > k:
                edge = np.partition(scores, len(left) - k)[len(left) - k]
                kept = scores >= edge
                left, scores = left[kept], scores[kept]
            best = np.lexsort((ids[left], -scores))[:k]
            out.append((np.full(len(best), names[r], np.int64), ids[left[best]], scores[best].astype(np.int64)))
    return out


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            (nq, qi, qv), (nv, vi, vv) = ([batch.column(c + o)[row].as_py() for c in range(3)] for o in (0, 3))
            q_ids, ids = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
            found = block_top_k(q_ids, np.frombuffer(qv, np.int64).reshape(nq, -1), ids, np.frombuffer(vv, np.int64).reshape(nv, -1), k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of which ``is_query`` holds, its ``k`` best other rows.

    Scores are inner products of components times ``scale``, floored. Null ids
    and vectors that are null or hold a null or non-finite component take no
    part; vectors of different lengths are an error; rows other than the query
    by id are candidates, so of repeated ids none is the other's candidate;
    fewer than ``k`` candidates give fewer rows, an empty table none.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = written(rows.mapInArrow(lambda it: _pack(it, BLOCK, scale), PACKED), "blocks")
    asked = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = written(asked.coalesce(max(1, asked.rdd.getNumPartitions() // 8)).mapInArrow(lambda it: _pack(it, QUERY_BLOCK, scale), PACKED), "asked")
    groups = max(1, -(-blocks.count() // BLOCKS_A_GROUP))
    left = asked.toDF("qn", "qi", "qv").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    near = left.join(right, "g").select("qn", "qi", "qv", "n", "ids", "vectors").mapInArrow(lambda it: _meet(it, k), FOUND)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
