"""Repeated passages by distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else. Every window of that length has an anchor, its gram of ``GRAM`` bytes with
the least hash (the leftmost of equals), which depends on the window's bytes
alone: equal windows have equal anchors at equal places. Neighbouring windows
share anchors, so a text is a short list of runs of windows, and only suffixes
at anchors need sorting.

1. Documents are bundled in chunks of some megabytes, written once.
2. Each chunk sends its anchors' gram hashes, sorted, to ranges of the hash
   space; what comes back is which of them occur more than once.
3. Of those, a chunk builds the suffix at the anchor followed by the reversed
   bytes before it, sorts them, keeps one of equal ones, and sends each range a
   front-coded run: common prefix lengths and remainders.
4. A range merges its runs with a loser tree that compares from the known
   common prefix on; the merged order's common prefixes delimit the suffixes
   with the same anchor, among which equal windows are found. Each chunk gets
   back the byte ranges to remove.

A gram or passage of any frequency is at most one entry of each run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of an anchor's gram; a power of two.
GRAM = 32
#: Bytes of text in a chunk, unless one document alone has more.
CHUNK_BYTES = 4 << 20
#: Bytes of text a range of the hash space; there are at least so many ranges.
RANGE_BYTES, LEAST_RANGES = 16 << 20, 48
#: Windows whose anchors are found at once; positions in such a slab have so many bits.
SLAB, POSITION_BITS = 1 << 20, 24
#: Runs merged at once.
FAN_IN = 64

CHUNK = "chunk string, doc_ids array<long>, starts binary, data binary"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _zip(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    ids, texts, held, made = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        starts = np.cumsum([0, *map(len, texts)], dtype=np.int64)
        row = ([f"{TaskContext.get().partitionId()}-{made}"], [ids], [starts.tobytes()], [_zip(b"".join(texts))])
        kinds = (pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["chunk", "doc_ids", "starts", "data"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            own = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if ids and held + len(own) > size:
                yield flush()
                ids, texts, held, made = [], [], 0, made + 1
            ids.append(doc.as_py())
            texts.append(own)
            held += len(own) + 8
    if ids:
        yield flush()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each gram of ``GRAM`` bytes, by doubling."""
    h, span, mult = data.astype(np.uint64) + np.uint64(1), 1, int(_M1)
    while span < GRAM:
        h = h[:-span] * np.uint64(mult) + h[span:]
        span, mult = 2 * span, mult * mult & ((1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def _least_in(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts at ``starts`` in ``data``: gram hash and position of each anchor, and its first and last window's start."""
    out: list[tuple[np.ndarray, ...]] = []
    width, n = length - GRAM + 1, len(data)
    ends = np.empty(n + 1, np.int64)  # where the text of each byte ends
    ends[-1] = 0
    ends[:-1] = np.repeat(starts[1:], np.diff(starts))
    for at in range(0, max(0, n - length + 1), SLAB):
        part = data[at : at + SLAB + length - 1]
        if len(part) < length:
            break
        h = _gram_hashes(part)
        keyed = (h & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        where = (_least_in(keyed, width) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        window = np.arange(at, at + len(where))
        fits = window + length <= ends[window]
        window, where = window[fits], where[fits] + at
        if len(window):
            new = np.concatenate([[True], (where[1:] != where[:-1]) | (window[1:] != window[:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(window)) - 1
            out.append((h[where[first] - at], where[first], window[first], window[last]))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    grams, *places = (np.concatenate(c) for c in zip(*out, strict=True))
    grams = (grams ^ (grams >> np.uint64(31))) * _M1  # anchors have small hashes: spread them over the hash space
    return grams ^ (grams >> np.uint64(32)), *places


def _range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _send_grams(batches: Iterator[pa.RecordBatch], length: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            data = np.frombuffer(_unzip(batch.column("data")[row].as_py()), np.uint8)
            grams = anchors(data, np.frombuffer(batch.column("starts")[row].as_py(), np.int64), length)[0]
            own, count = np.unique(grams, return_counts=True)
            part = _range_of(own, ranges)
            edges = np.searchsorted(part, np.arange(ranges + 1))
            rows = [(p, own[a:b].tobytes(), np.packbits(count[a:b] > 1).tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            name = batch.column("chunk")[row].as_py()
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([name] * len(rows), pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["part", "chunk", "grams", "twice"])


def _repeated(table: pa.Table) -> pa.Table:
    """For each chunk's grams of one range, whether each occurs more than once anywhere."""
    runs = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(r)].astype(bool) for x, r in zip(table.column("twice"), runs, strict=True)]
    every = np.concatenate([*runs, np.zeros(0, np.uint64)])
    own, count = np.unique(np.concatenate([every, *(r[t] for r, t in zip(runs, twice, strict=True))]), return_counts=True)
    many = own[count > 1]
    flags = [np.packbits(np.isin(r, many, assume_unique=True)).tobytes() for r in runs]
    return pa.table([table.column("part"), table.column("chunk"), pa.array(flags, pa.binary())], ["part", "chunk", "flags"])


def front_coded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix length of each sorted string with the one before, and the remainders."""
    if not texts:
        return np.zeros(0, np.int32), []
    width = max(map(len, texts))
    lcp = np.zeros(len(texts), np.int32)
    for at in range(0, len(texts), 8192):
        part = texts[max(0, at - 1) : at + 8192]
        rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in part), np.uint8).reshape(len(part), width)
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lens = np.fromiter(map(len, part), np.int64)
        got = np.minimum(first, np.minimum(lens[1:], lens[:-1]))
        lcp[at + (at == 0) : at + (at == 0) + len(got)] = got
    return lcp, [t[h:] for t, h in zip(texts, lcp.tolist(), strict=True)]


def _send_runs(batches: Iterator[pa.RecordBatch], length: int, ranges: int) -> Iterator[pa.RecordBatch]:
    names = ["part", "chunk", "run"]
    for batch in batches:
        for row in range(batch.num_rows):
            raw = _unzip(batch.column("data")[row].as_py())
            grams, x, first, last = anchors(np.frombuffer(raw, np.uint8), np.frombuffer(batch.column("starts")[row].as_py(), np.int64), length)
            own = np.unique(grams)
            part = _range_of(own, ranges)
            many = np.zeros(len(own), bool)
            for f in batch.column("flags")[row].as_py():
                a, b = np.searchsorted(part, [f["part"], f["part"] + 1])
                many[a:b] = np.unpackbits(np.frombuffer(f["flags"], np.uint8))[: b - a].astype(bool)
            use = np.flatnonzero(many[np.searchsorted(own, grams)]) if len(own) else np.zeros(0, np.int64)
            by: dict[int, dict[tuple[bytes, int], list[int]]] = {}
            for p, at, lo, hi in zip(_range_of(grams[use], ranges).tolist(), x[use].tolist(), first[use].tolist(), last[use].tolist(), strict=True):
                back = at - lo
                key = (raw[at : hi + length] + raw[lo:at][::-1], back)
                by.setdefault(p, {}).setdefault(key, []).append(at)
            rows = []
            for p, entries in by.items():
                keys = sorted(entries)
                lcp, tails = front_coded([k[0] for k in keys])
                places = [entries[k] for k in keys]
                blob = [lcp.astype("<i4").tobytes(), np.fromiter(map(len, tails), "<i4", len(tails)).tobytes(), np.array([k[1] for k in keys], "<i4").tobytes(), np.fromiter(map(len, places), "<i4", len(places)).tobytes(), np.array([a for o in places for a in o], "<i8").tobytes()]
                rows.append((p, np.array([len(keys), sum(map(len, places))], "<i8").tobytes() + _zip(b"".join([*blob, *tails]))))
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([batch.column("chunk")[row].as_py()] * len(rows), pa.string()), pa.array(cols[1], pa.binary())], names)


class Run:
    """A front-coded run, decoded as it is read."""

    def __init__(self, blob: bytes):
        n, m = np.frombuffer(blob[:16], "<i8").tolist()
        raw = _unzip(blob[16:])
        ints = np.frombuffer(raw[: 16 * n], "<i4").reshape(4, n) if n else np.zeros((4, 0), np.int32)
        self.lcps, sizes, self.backs = ints[0].tolist(), ints[1], ints[2].tolist()
        self.counts = ints[3]
        self.places = np.frombuffer(raw[16 * n : 16 * n + 8 * m], "<i8")
        self.ends = (16 * n + 8 * m + np.cumsum(sizes)).tolist()
        self.begin, self.raw = 16 * n + 8 * m, raw

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """(common prefix with the string before, string)"""
        text, at = b"", self.begin
        for h, end in zip(self.lcps, self.ends, strict=True):
            text = text[:h] + self.raw[at:end]
            at = end
            yield h, text


def _common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, of which ``h`` bytes are known."""
    n = min(len(a), len(b))
    step = 8
    while h < n:
        if a[h : h + step] == b[h : h + step]:
            h = min(n, h + step)
            step *= 4
        elif step == 1:
            break
        else:
            step = max(1, step // 8)
    return h


def merge_runs(sources: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(common prefix with the string before, string, source) in order: a loser tree that compares from known prefixes on.

    A player holds the length of its common prefix with the last winner. Of two,
    the one with the longer prefix is the less; only if both are equal are bytes
    compared, from there on, and the loser's new prefix is what they share.
    """
    k = len(sources)
    if k == 0:
        return
    texts: list[bytes | None] = [None] * k
    known = [0] * k
    for i, s in enumerate(sources):
        got = next(s, None)
        texts[i] = None if got is None else got[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = texts[a], texts[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        ha, hb = known[a], known[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        h = _common(x, y, ha)
        if x[h : h + 1] < y[h : h + 1] or (x[h : h + 1] == y[h : h + 1] and a < b):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    losers = [-1] * k
    winners = [-1] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while texts[top] is not None:
        yield known[top], texts[top], top
        got = next(sources[top], None)
        if got is None:
            texts[top] = None
        else:
            known[top], texts[top] = got
        node, winner = (top + k) // 2, top
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
        top = winner


def _merged(runs: list[Run]) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """(common prefix, string, its (run, entry) pairs) of all runs in order; more runs than ``FAN_IN`` are merged in rounds."""

    def leaf(r: int) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
        for e, (h, text) in enumerate(runs[r]):
            yield h, text, [(r, e)]

    def join(parts: list) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
        tags: list[list] = [[] for _ in parts]

        def feed(i: int) -> Iterator[tuple[int, bytes]]:
            for h, text, tag in parts[i]:
                tags[i] = tag
                yield h, text

        gaps, last, held = 0, None, []
        # a source is asked for its next string only after its last was taken up
        for h, text, i in merge_runs([feed(i) for i in range(len(parts))]):
            if last is not None and h == len(text) == len(last):
                held.extend(tags[i])
                continue
            if last is not None:
                yield gaps, last, held
            gaps, last, held = h, text, list(tags[i])
        if last is not None:
            yield gaps, last, held

    level = [leaf(r) for r in range(len(runs))]
    while len(level) > 1:
        level = [join(level[a : a + FAN_IN]) for a in range(0, len(level), FAN_IN)]
    return level[0] if level else iter(())


def _equal_windows(group: list[tuple[bytes, int, int, bool]], length: int) -> list[list[tuple[int, int]]]:
    """For each suffix (string, bytes before the anchor, bytes of its forward part, occurs twice) the offsets before
    the anchor, as inclusive ranges, of windows that occur more than once."""
    found: list[list[tuple[int, int]]] = [[] for _ in group]
    spans = [(max(0, length - fore), back) for _, back, fore, _ in group]
    whole = [s[3] for s in group]
    if len(group) == 2:
        (x, bx, fx, _), (y, by, fy, _) = group
        fore = min(_common(x[:fx], y[:fy], GRAM), length)
        back = _common(x[fx:], y[fy:], 0)
        lo, hi = max(spans[0][0], spans[1][0], length - fore), min(bx, by, back)
        if lo <= hi:
            found = [[(lo, hi)], [(lo, hi)]]
    elif len(group) > 2:
        hits: list[list[int]] = [[] for _ in group]
        for i in range(min(a for a, _ in spans), max(b for _, b in spans) + 1):
            seen: dict[tuple[bytes, bytes], int] = {}
            for k, (text, _, fore, _) in enumerate(group):
                if spans[k][0] <= i <= spans[k][1]:
                    other = seen.setdefault((text[: length - i], text[fore : fore + i]), k)
                    if other != k:
                        hits[k].append(i)
                        if not hits[other] or hits[other][-1] != i:
                            hits[other].append(i)
        for k, own in enumerate(hits):
            for i in own:
                if found[k] and found[k][-1][1] == i - 1:
                    found[k][-1] = (found[k][-1][0], i)
                else:
                    found[k].append((i, i))
    return [[span] if w and span[0] <= span[1] else f for f, w, span in zip(found, whole, spans, strict=True)]


def _resolve(table: pa.Table, length: int) -> pa.Table:
    """For each chunk's run of one range, the byte ranges whose windows occur more than once."""
    runs = [Run(x.as_py()) for x in table.column("run")]
    verdicts: list[list[tuple[int, int, int]]] = [[] for _ in runs]

    def settle(group: list[tuple[bytes, int, list[tuple[int, int]]]]) -> None:
        if len(group) == 1 and len(group[0][2]) == 1 and runs[group[0][2][0][0]].counts[group[0][2][0][1]] == 1:
            return
        suffixes = [(text, back, len(text) - back, len(tags) > 1 or bool(runs[tags[0][0]].counts[tags[0][1]] > 1)) for text, back, tags in group]
        for (_, _, tags), ranges in zip(group, _equal_windows(suffixes, length), strict=True):
            for r, e in tags:
                verdicts[r] += [(e, lo, hi) for lo, hi in ranges]

    group: list = []
    for h, text, tags in _merged(runs):
        if group and h < GRAM:
            settle(group)
            group = []
        by_back: dict[int, list[tuple[int, int]]] = {}
        for r, e in tags:
            by_back.setdefault(runs[r].backs[e], []).append((r, e))
        group += [(text, back, own) for back, own in by_back.items()]
    if group:
        settle(group)
    out = []
    for run, own in zip(runs, verdicts, strict=True):
        if not own:
            out.append((b"", b""))
            continue
        e, lo, hi = np.array(own, np.int64).T
        first = np.concatenate([[0], np.cumsum(run.counts)])
        reps = run.counts[e]
        index = np.repeat(first[e] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        at = run.places[index]
        out.append(((at - np.repeat(hi, reps)).astype("<i8").tobytes(), (at - np.repeat(lo, reps) + length).astype("<i8").tobytes()))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([table.column("chunk"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["chunk", "starts", "ends"])


def _apply(batches: Iterator[pa.RecordBatch], with_kept: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            raw = _unzip(batch.column("data")[row].as_py())
            starts = np.frombuffer(batch.column("starts")[row].as_py(), np.int64)
            edge = np.zeros(len(raw) + 1, np.int32)
            for r in batch.column("ranges")[row].as_py() or ():
                np.add.at(edge, np.frombuffer(r["starts"], "<i8"), 1)
                np.add.at(edge, np.frombuffer(r["ends"], "<i8"), -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = gone[a:b]
                kept = np.frombuffer(raw, np.uint8, b - a, a)[~own].tobytes() if b > a else b""
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if b > a else 0
                rows.append((b - a, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True))
            out = [batch.column("doc_ids")[row].values, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=False))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                out, names = [*out, pa.array(cols[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names)


def remove_repeats(docs: DataFrame, length: int = 200, chunk_bytes: int = CHUNK_BYTES, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked).

    Null texts are empty; texts shorter than ``length`` lose nothing; repeated
    rows are repeats of each other; null ids are kept; other columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = written(texts.mapInArrow(lambda it: _chunks(it, chunk_bytes), CHUNK), "chunks", "none")
    total = chunks.select(F.sum(F.octet_length("data"))).first()[0] or 0
    ranges = max(LEAST_RANGES, 3 * total // RANGE_BYTES)
    data = chunks.select("chunk", "starts", "data")
    grams = data.mapInArrow(lambda it: _send_grams(it, length, ranges), "part int, chunk string, grams binary, twice binary")
    flags = grams.groupBy("part").applyInArrow(_repeated, "part int, chunk string, flags binary")
    flags = flags.groupBy("chunk").agg(F.collect_list(F.struct("part", "flags")).alias("flags"))  # a row a range
    runs = data.join(flags, "chunk").mapInArrow(lambda it: _send_runs(it, length, ranges), "part int, chunk string, run binary")
    gone = runs.groupBy("part").applyInArrow(lambda t: _resolve(t, length), "chunk string, starts binary, ends binary")
    gone = gone.filter(F.octet_length("starts") > 0).groupBy("chunk").agg(F.collect_list(F.struct("starts", "ends")).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return chunks.join(gone, "chunk", "left").mapInArrow(lambda it: _apply(it, with_kept), schema)
