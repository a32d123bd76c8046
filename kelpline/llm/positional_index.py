"""Benchmark decontamination over a positional inverted index.

The index is a table of segments, one row for some megabytes of documents, as
in a search engine: the segment's terms, each term's postings (word positions
in ascending order, as differences), and where each document begins. Segments
are built where the documents lie, without a shuffle, and are written to the
shared folder once. A search ships the benchmark's windows, in blocks of bounded
size, to the segments; inside a segment windows start from the postings of their
rarest terms and intersect them, offset-adjusted, with those of their next rarer
terms until they are empty or the phrases are verified, many windows at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of text in a segment, unless one document alone has more.
SEGMENT_BYTES = 4 << 20
#: Benchmark words shipped to the segments at a time; a larger benchmark takes several passes.
BLOCK_WORDS = 500_000
#: Postings of rarest terms that are intersected at once, unless one term alone has more.
AT_ONCE = 1 << 20
#: Words: A-Z are lower-cased, and all other ASCII but digits and letters separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SEGMENT = "segment string, doc_id array<long>, doc_start binary, terms binary, term_start binary, postings binary"
FOUND = "segment string, ord int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _segment(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
    known = _Ids()
    flat = np.fromiter((i for own in words for i in map(known.__getitem__, own)), np.int32, sum(map(len, words)))
    order = np.argsort(flat, kind="stable").astype(np.uint32)
    counts = np.bincount(flat, minlength=len(known))
    term_start = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)
    deltas = np.diff(order, prepend=np.uint32(0)).astype(np.uint32)
    deltas[term_start[:-1]] = order[term_start[:-1]]
    doc_start = np.cumsum([0, *map(len, words)]).astype(np.uint32)
    name = hashlib.blake2b(order.tobytes() + repr(ids[:64]).encode(), digest_size=16).hexdigest()
    row = ([name], [ids], [doc_start.tobytes()], [b"\n".join(known)], [term_start.tobytes()], [deltas.tobytes()])
    kinds = (pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in SEGMENT.split(", ")])


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    ids, words, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            own = words_of(text.as_py())
            n = len(text.as_py() or "")
            if ids and held + n > size:
                yield _segment(ids, words)
                ids, words, held = [], [], 0
            ids.append(doc.as_py())
            words.append(own)
            held += n + 16
    if ids:
        yield _segment(ids, words)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index of ``docs``: every word of every text. Null texts have no words; repeated rows are documents of their own."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(texts.mapInArrow(lambda it: _segments(it, segment_bytes), SEGMENT), "segments")


class Segment:
    """One row of the index in memory."""

    def __init__(self, doc_ids: list, doc_start: bytes, terms: bytes, term_start: bytes, postings: bytes):
        self.doc_ids = doc_ids
        self.doc_start = np.frombuffer(doc_start, "<u4").astype(np.int64)
        self.terms = dict(zip(terms.split(b"\n"), range(1 << 31), strict=False)) if terms else {}
        self.term_start = np.frombuffer(term_start, "<u4").astype(np.int64)
        self.deltas = np.frombuffer(postings, "<u4")
        self.known: dict[int, np.ndarray] = {}
        self.sorted: np.ndarray | None = None

    def df(self, term: int) -> int:
        return int(self.term_start[term + 1] - self.term_start[term])

    def postings(self, term: int) -> np.ndarray:
        if term not in self.known:
            self.known[term] = np.cumsum(self.deltas[self.term_start[term] : self.term_start[term + 1]], dtype=np.int64)
        return self.known[term]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, at, "right") - 1

    def keys(self) -> np.ndarray:
        """All postings as term times the segment's words plus position, ascending."""
        if self.sorted is None:
            size = np.diff(self.term_start)
            total = np.concatenate([[0], np.cumsum(self.deltas, dtype=np.int64)])
            at = total[1:] - np.repeat(total[self.term_start[:-1]], size)
            self.sorted = np.repeat(np.arange(len(size)), size) * int(self.doc_start[-1]) + at
        return self.sorted

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of every place at which a row of ``terms`` stands in one document."""
        df = np.diff(self.term_start)
        order = np.argsort(df[terms], axis=1, kind="stable") if len(terms) else terms
        rarest = df[terms[np.arange(len(terms)), order[:, 0]]] if len(terms) else df[:0]
        out, a = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        ends = np.cumsum(rarest)
        while a < len(terms):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            out.append(self._phrases(np.arange(a, b), terms, order))
            a = b
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _phrases(self, rows: np.ndarray, terms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, n, size = self.keys(), int(self.doc_start[-1]), terms.shape[1]
        first = terms[rows, order[rows, 0]]
        df = self.term_start[first + 1] - self.term_start[first]
        row = np.repeat(rows, df)
        at = keys[np.repeat(self.term_start[first] - np.cumsum(df) + df, df) + np.arange(len(row))] - np.repeat(first, df) * n - order[row, 0]
        good = (at >= 0) & (at + size <= n)
        row, at = row[good], at[good]
        for j in range(1, size):
            k = order[row, j]
            want = terms[row, k] * n + at + k
            there = np.searchsorted(keys, want)
            good = keys[np.minimum(there, len(keys) - 1)] == want
            row, at = row[good], at[good]
        one = self.doc_of(at) == self.doc_of(at + size - 1)
        return row[one], at[one]

    def near(self, terms: Sequence[int], span: int) -> np.ndarray:
        """Starts of the least stretches of at most ``span`` words of one document that hold all of ``terms``."""
        each = [self.postings(t) for t in sorted(set(terms), key=self.df)]
        rare = each[0]
        for own in each[1:]:
            lo, hi = np.searchsorted(own, rare - span + 1), np.searchsorted(own, rare + span - 1, "right")
            rare = rare[lo < hi]
        starts = set()
        for p in rare.tolist():
            for own in each:
                for s in own[np.searchsorted(own, p - span + 1) : np.searchsorted(own, p, "right")].tolist():
                    ends = [x[np.searchsorted(x, s)] if np.searchsorted(x, s) < len(x) else s + span for x in each]
                    if max(ends) < s + span and self.doc_of(np.array([s]))[0] == self.doc_of(np.array([max(ends)]))[0]:
                        starts.add(s)
        return np.array(sorted(starts), np.int64)


#: A block of the benchmark as plain values, which any worker can read: distinct words, item ids, and by window size the
#: distinct windows as rows of word numbers, where each one's items begin, and their numbers.
Windows = tuple[list[bytes], list[str], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def windows_of(items: Sequence[tuple[str, str | None]], n: int) -> Windows:
    known = _Ids()
    by: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, (_, text) in enumerate(items):
        own = np.array([known[w] for w in words_of(text)], np.int64)
        if len(own):
            size = min(n, len(own))
            by.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(own, size), k))
    out = {}
    for size, parts in by.items():
        rows, which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.repeat([k for _, k in parts], [len(w) for w, _ in parts])]), axis=1)
        out[size] = (rows, np.searchsorted(pairs[0], np.arange(len(rows) + 1)), pairs[1])
    return list(known), [item for item, _ in items], out


def _search(batches: Iterator[pa.RecordBatch], block: Windows) -> Iterator[pa.RecordBatch]:
    words, names, by_size = block
    for batch in batches:
        for row in range(batch.num_rows):
            name, doc_ids, *parts = (c[row].as_py() for c in batch.columns)
            seg = Segment(doc_ids, *parts)
            local = np.array([seg.terms.get(w, -1) for w in words] or [-1], np.int64)
            n = len(doc_ids)
            hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            for size, (windows, first, owners) in by_size.items():
                terms = local[windows]
                there = np.flatnonzero((terms >= 0).all(axis=1))
                which, at = seg.phrases(terms[there])
                docs = seg.doc_of(at)
                for w, p, d in zip(there[which].tolist(), (at - seg.doc_start[docs]).tolist(), docs.tolist(), strict=True):
                    hits[d].append((p, p + size))
                    items[d].update(names[k] for k in owners[first[w] : first[w + 1]])
            merged = [_merge(h) for h in hits]
            cols = ([name] * n, range(n), doc_ids, np.diff(seg.doc_start), [[a for a, _ in m] for m in merged], [[b for _, b in m] for m in merged], [sorted(x) for x in items])
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending runs that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends, items = (batch.column(k).to_pylist() for k in (2, 3, 4))
        runs = [_merge([*zip(a, b, strict=True)]) for a, b in zip(starts, ends, strict=True)]
        names = [sorted(set(x)) for x in items]
        hit = [sum(b - a for a, b in r) for r in runs]
        cols = [
            pa.array(hit, pa.int64()), pa.array(map(len, names), pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array([h > 0 for h in hit]),
            pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(names, pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"])


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's rows, some at a time: of at most ``most`` words unless one item has more."""
    held, words = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null").toLocalIterator():
        n = len(words_of(text))
        if held and words + n > most:
            yield held
            held, words = [], 0
        held.append((item, text))
        words += n
    yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, segment_bytes: int = SEGMENT_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items.

    A window is ``window`` consecutive words of an item, or a shorter item
    whole; words inside any occurrence are hit. hits: runs of hit words. Items
    without id are left out; items without words have no window; repeated rows
    of either table count each; an empty benchmark hits nothing.
    """
    index = build_index(docs, segment_bytes)
    found = None
    blocks = 0
    for items in _blocks(benchmark, block_words):
        block = docs.sparkSession.sparkContext.broadcast(windows_of(items, window))
        own = index.mapInArrow(lambda it, b=block: _search(it, b.value), FOUND)
        found, blocks = own if found is None else found.unionByName(own), blocks + 1
    if blocks > 1:
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("segment", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("starts"), flat("ends"), flat("items"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start: int, end: int>>, items array<string>"
    return found.select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(_digest, schema)


def _near(batches: Iterator[pa.RecordBatch], queries: list[tuple[str, list[bytes]]], slop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            _, doc_ids, *parts = (c[row].as_py() for c in batch.columns)
            seg = Segment(doc_ids, *parts)
            for name, words in queries:
                terms = [seg.terms.get(w, -1) for w in words]
                if terms and min(terms) >= 0:
                    at = seg.near(terms, len(terms) + slop)
                    rows += [(name, doc_ids[d], int(p - seg.doc_start[d])) for p, d in zip(at.tolist(), seg.doc_of(at).tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["query", "doc_id", "start"])


def proximity_matches(index: DataFrame, queries: Sequence[tuple[str, str]], slop: int) -> DataFrame:
    """Where all words of a query stand, in any order, within its distinct length plus ``slop`` words: query, doc_id, start."""
    parsed = [(name, list(dict.fromkeys(words_of(text)))) for name, text in queries]
    return index.mapInArrow(lambda it: _near(it, parsed, slop), "query string, doc_id long, start long")
