"""Packing documents into sequences of a fixed number of tokens: best-two-fit.

Documents longer than a sequence are cut into whole sequences and a rest.
Pieces are dealt by a hash into groups of about ``group_pieces``; each group is
packed by itself, so memory is bounded and a lost task is done again alone. A
group loses at most its last sequence, under one in a thousand.

In a group, a bin takes the longest unpacked piece and then, again and again,
the longest that still fits. When none fits, its smallest piece is exchanged
for two unpacked pieces that fill the expanded gap more tightly, if there are
any. Lengths are kept as counts, and the lengths at hand as bits of an integer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .word_encoder import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A piece's number among those of its task: it deals repeated rows to several groups.
NTH = "nth long"


def _cut_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, seen = encoder(path), 0
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        for first, last in slices(texts):
            ids, at = enc.encode_flat(texts.slice(first, last - first).to_pylist(), [end_id])
            rows: list[tuple] = []
            for doc, a, b in zip(docs[first:last], at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k, lo in enumerate(range(a, b, capacity)):
                    own = ids[lo : min(b, lo + capacity)]
                    rows.append((doc, k, lo - a, len(own), zlib.crc32(own), own.view("<i4") if with_ids else None))
            cols = list(zip(*rows, strict=True))
            out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(cols[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(range(seen, seen + len(rows)), pa.int64())], [*names, "nth"])
            seen += len(rows)


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, all between 1 and ``capacity``."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        by_length.setdefault(n, []).append(i)
    mask = 0
    for n in by_length:
        mask |= 1 << n
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def longest(limit: int) -> int:
        """The longest unpacked length of at most ``limit``, or 0."""
        return max(0, (mask & ((2 << limit) - 1)).bit_length() - 1) if limit > 0 else 0

    def take(n: int) -> int:
        nonlocal mask
        i = by_length[n].pop()
        if not by_length[n]:
            mask ^= 1 << n
        return i

    def two(limit: int, over: int) -> tuple[int, int]:
        """Two unpacked lengths with the largest sum of at most ``limit`` and more than ``over``."""
        best, found, a = over, (0, 0), longest(limit - 1)
        while a and 2 * a > best:
            b = longest(min(a, limit - a))
            if b == a and len(by_length[a]) < 2:
                b = longest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == limit:
                    break
            a = longest(a - 1)
        return found

    bins = 0
    while mask:
        held: list[int] = []
        gap = capacity
        while n := longest(gap):
            held.append(take(n))
            gap -= n
        while gap and mask:
            k = min(range(len(held)), key=lambda k: lengths[held[k]])
            small = int(lengths[held[k]])
            a, b = two(gap + small, small)
            if not a:
                break
            back = held.pop(k)
            held += [take(a), take(b)]
            by_length.setdefault(small, []).append(back)
            mask |= 1 << small
            gap += small - a - b
        at = 0
        for i in held:
            bin_of[i], offset[i] = bins, at
            at += int(lengths[i])
        bins += 1
    return bin_of, offset


def _pack_group(table: pa.Table, capacity: int, stride: int) -> pa.Table:
    if not table.num_rows:
        return table.drop(["grp"])
    group = table.column("grp")[0].as_py()
    table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    bin_of, offset = pack(table.column("length").to_numpy(), capacity)
    table = table.drop(["grp"]).append_column("sequence_id", pa.array(group * stride + bin_of))
    return table.append_column("offset", pa.array(offset))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, group_pieces: int = 8192, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked).

    A null or empty text is its end id alone. Repeated rows are packed each;
    null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(texts.mapInArrow(lambda it: _cut_batches(it, tokenizer_path, end_id, capacity, with_ids), f"{schema}, {NTH}"), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(groups))).drop("nth")
    stride = group_pieces * 1024
    return dealt.groupBy("grp").applyInArrow(lambda t: _pack_group(t, capacity, stride), schema + ", sequence_id long, offset long")
