"""Jaccard self-join of documents' word n-gram sets, by prefixes of token combinations.

A set's grams are ordered, rare ones first. A similar set lacks at most ``lack``
of them, so two similar sets share a signature if each indexes a prefix whose
signatures survive any ``lack`` losses. A rare gram is a signature by itself,
but in large sets. Other grams are dealt by their hash into classes and indexed
as pairs of one class, very frequent ones as triples, so a prefix is extended
until single grams, pairs' grams beyond the first of a class and triples' beyond
the second are more than ``lack``. The larger a set, the more classes; a set to which smaller ones
with fewer classes may be similar is indexed with their number of classes too.

Equal sets are collapsed first, and of signatures that the same sets share one
is kept. The sets that share a signature are compared with one of them, then,
where these links leave several components, a set of each with another one of
them. What is still in several components is compared pair by pair across these,
by signature and size. Pairs are verified only where the sets' sizes and parities
allow similarity. Every link between different sets either is verified or joins
sets already connected. Where links are counted, all pairs inside a component
are compared, by blocks of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, worker_cache, written
from .components import components

#: Set sizes from which on frequent grams are dealt into so many classes. With five grams a class, more than ``lack`` are always left beyond the first of pairs' and the first two of triples' classes where similarity is above 3/4.
LEVELS = ((0, 1), (40, 8), (320, 64), (1280, 256), (5120, 1024), (20480, 4096))
#: Levels from this one on index rare grams in pairs too, if grams are of so many words at most: the prefix of a large set is long, and some of its short grams are in others by chance.
PAIRED, PAIRED_WORDS = 2, 3
#: Documents with a gram from which on it is frequent (indexed in pairs) and very frequent (in triples).
FREQUENT, VERY_FREQUENT = 8, 256
#: Grams counted together, and the least count in them that is reported; the most frequent grams known (a bound of what is broadcast: the rest count as rare, which costs time but no link).
COUNTED, REPORTED, KNOWN = 2_000_000, 3, 400_000
CACHE_WORDS = 250_000
#: Longs of a set's parities: each gram flips one bit, so sets differ in at least as many grams as their parities in bits.
PARITY_LONGS = 16
#: The same of sets of at least so many grams, for pairs that the others leave open: in long sets few parities say nothing.
LONG_SET, LONG_PARITY_LONGS = 1500, 128

#: Texts to verify are looked up by so many hash values of their rows first: a bound of what is broadcast.
ROW_BUCKETS = 1 << 20
#: About so many sets of a component are in a block; grams in whose columns two blocks are multiplied at once.
LINK_BLOCK, LINK_COLUMNS = 256, 16_384

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M3
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct n-grams of words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer
    words than ``n`` are one gram; a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_cache("gram words", _Hashes)
    if len(known) > CACHE_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    grams = h[: len(h) - k + 1] * _M1
    for i in range(1, k):
        grams = (grams + h[i : len(h) - k + 1 + i]) * _M1
    if k < n:
        grams = grams + np.uint64(k)
    return np.unique(_mix(grams))


def _key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def parities(grams: np.ndarray, longs: int = PARITY_LONGS) -> np.ndarray:
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


DOC_AND_COUNT = "doc_id long, n long, key binary, gram long, n_docs long"


def _survey(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row a document (id, set size, set key) and rows of grams that are frequent here."""
    held: list[np.ndarray] = []
    size = 0
    names = [c.split()[0] for c in DOC_AND_COUNT.split(", ")]

    def counts() -> pa.RecordBatch:
        own, c = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        own, c = own[c >= REPORTED], c[c >= REPORTED]
        nothing = [pa.nulls(len(own), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*nothing, pa.array(own.view(np.int64)), pa.array(c.astype(np.int64))], names)

    for batch in batches:
        sizes, keys = [], []
        for text in batch.column(1):
            grams = gram_set(text.as_py(), n)
            sizes.append(len(grams))
            keys.append(_key(grams))
            held.append(grams)
            size += len(grams)
            if size >= COUNTED:
                yield counts()
                held, size = [], 0
        nothing = [pa.nulls(batch.num_rows, pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *nothing], names)
    yield counts()


def _places(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by class, stable; in that order each element's place among those of its class)."""
    order = np.argsort(of, kind="stable")
    own = of[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return order, np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))


def _earlier(at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``at`` (elements sorted by class) with every earlier one of its class: (indexes into ``at``, earlier elements)."""
    n = place[at]
    i = np.repeat(np.arange(len(at)), n)
    return i, at[i] - n[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _combinations(tail: np.ndarray, wide: np.ndarray, need: int, level: int, classes: int) -> list[np.ndarray]:
    """Pairs, and triples of the ``wide`` ones, of each class in the shortest start of ``tail`` in which more than ``need`` losses are needed to break them all."""
    of = (tail % np.uint64(classes)).astype(np.int64) + classes * wide
    order, place = _places(of)
    counts = np.zeros(len(tail), bool)
    counts[order] = place > wide[order]
    end = int(np.searchsorted(np.cumsum(counts), need + 1)) + 1
    order = order[order < end]  # places don't change: later ones of a class stand behind
    place = _places(of[order])[1]
    own, is_wide = tail[order], wide[order]
    at = np.arange(len(own))
    i, j = _earlier(at, place)
    two = ~is_wide[i]
    out = [_mix(own[j[two]] * _M1 + own[i[two]] * _M2 + np.uint64(16 + level))]
    i, j = i[~two], j[~two]
    k, h = _earlier(j, place)
    out.append(_mix(own[h] * _M1 + own[j[k]] * _M2 + own[i[k]] * _M3 + np.uint64(32 + level)))
    return out


def _level(n: int) -> int:
    return sum(n >= least for least, _ in LEVELS) - 1


def _ordered(grams: np.ndarray, most: int, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(grams, rare ones first, how many are rare, which are very frequent), of which ``most`` rare ones are enough."""
    for part in (grams[: 2 * most], grams):  # mostly the start holds so many
        at = np.minimum(np.searchsorted(frequent, part), len(frequent) - 1) if len(frequent) else None
        often = frequent[at] == part if len(frequent) else np.zeros(len(part), bool)
        rare = part[~often]
        if len(rare) >= most:
            return rare[:most], most, np.zeros(most, bool)
    by = at[often]
    order = np.argsort(rank[by], kind="stable")
    return np.concatenate([rare, part[often][order]]), len(rare), np.concatenate([np.zeros(len(rare), bool), rank[by][order] >= VERY_FREQUENT])


def signatures(grams: np.ndarray, num: int, den: int, frequent: np.ndarray, rank: np.ndarray, paired: int = PAIRED) -> np.ndarray:
    """Signatures of a set. frequent: sorted hashes with ``rank`` (the number of documents; rarer ones come first); paired: as ``PAIRED``."""
    n = len(grams)
    lack = n - -(-num * n // den)
    if 4 * num <= 3 * den:  # classes may hold too few
        return np.unique(_mix(grams[: lack + 1] + np.uint64(1)))
    out = []
    for level in range(_level(n - lack), _level(n) + 1):
        classes = LEVELS[level][1]
        single = level < paired
        ordered, n_rare, wide = _ordered(grams, lack + 1 if single else 2 * (lack + 1 + classes), frequent, rank)
        if single:
            out.append(_mix(ordered[: min(n_rare, lack + 1)] + np.uint64(1)))
            if n_rare <= lack:
                out += _combinations(ordered[n_rare:], wide[n_rare:], lack - n_rare, level, classes)
        else:
            out += _combinations(ordered, wide, lack, level, classes)
    return np.unique(np.concatenate(out))


def _index(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, frequent: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    paired = PAIRED if n <= PAIRED_WORDS else len(LEVELS)
    for batch in batches:
        rows: dict[bytes, tuple] = {}
        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            grams = gram_set(text.as_py(), n)
            key = _key(grams)
            if key in rows:
                old = rows[key]
                if doc is not None and (old[0] is None or doc < old[0]):
                    rows[key] = (doc, row, *old[2:])
            elif len(grams):
                rows[key] = (doc, row, len(grams), signatures(grams, num, den, frequent, rank, paired).view(np.int64), parities(grams), parities(grams, LONG_PARITY_LONGS) if len(grams) >= LONG_SET else [])
        cols = list(zip(*rows.values(), strict=True)) or [()] * 6
        kinds = (*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.binary()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["key", "doc_id", "row", "n", "sigs", "bits", "long_bits"])


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for what is shuffled; of a task's repeated rows one stays."""
    pack = zstandard.ZstdCompressor(level=1).compress
    seen: set[int] = set()
    for batch in batches:
        rows = [(r, t) for r, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if r not in seen and not seen.add(r)]
        data = [pack((t.as_py() or "").encode("utf-8", "surrogatepass")) for _, t in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array(data, pa.binary())], ["row", "data"])


def _unzipped_set(data: bytes, n: int) -> np.ndarray:
    return gram_set(zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass"), n)


def _verified(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar. Neighbouring rows share their first text, whose set is kept."""
    last, x = None, None
    for batch in batches:
        found = []
        for a, b, own, other in zip(*(batch.column(k) for k in range(4)), strict=True):
            if a != last:
                last, x = a, _unzipped_set(own.as_py(), n)
            y = _unzipped_set(other.as_py(), n)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * den >= (len(x) + len(y) - both) * num:
                found.append((a.as_py(), b.as_py()))
        cols = list(zip(*found, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _near_size(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _may_be_near(num: int, den: int) -> Column:
    """Whether sizes and parities of sets x and y leave it open that they are similar."""
    most = (F.col("n_x") + F.col("n_y")) * (den - num)
    differ = sum((F.bit_count(F.col("bits_x")[k].bitwiseXOR(F.col("bits_y")[k])) for k in range(PARITY_LONGS)), F.lit(0))
    long_differ = F.aggregate(F.zip_with("long_bits_x", "long_bits_y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    both_long = (F.size("long_bits_x") > 0) & (F.size("long_bits_y") > 0)
    return _near_size(F.col("n_x"), F.col("n_y"), num, den) & (differ * (den + num) <= most) & (~both_long | (long_differ * (den + num) <= most))


def _candidates(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that sizes and parities leave open."""
    x, y = (reps.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "bits", "long_bits"))) for k, s in (("a", "x"), ("b", "y")))
    return pairs.join(y, "b").join(x, "a").filter(_may_be_near(num, den)).select("a", "b")


def _bucket() -> Column:
    return F.pmod(F.col("row"), F.lit(ROW_BUCKETS)).cast("int").alias("bucket")


def _texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, data: the compressed text of each of ``nodes`` (node, row), one row each. Few others than theirs are shuffled."""
    nodes = written(nodes, "wanted")
    near = rows.withColumn("bucket", _bucket()).join(F.broadcast(nodes.select(_bucket()).distinct()), "bucket", "left_semi")  # at most ROW_BUCKETS numbers
    found = near.select("row", "text").mapInArrow(_zipped, "row long, data binary").join(nodes, "row")
    return written(found.groupBy("row", "node").agg(F.first("data").alias("data")).select("node", "data"), "texts", "none")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _shared(reps: DataFrame) -> DataFrame:
    """sig, node, n, c, n_c, k: the nodes of each signature that several have, the least of them, and their number. Of signatures with the same nodes one stays."""
    rows = reps.select("node", "n", F.explode("sigs").alias("sig"))
    repeated = rows.groupBy("sig").agg(F.min("node").alias("c"), F.max("node").alias("z")).filter("c != z")
    rows = written(rows.join(repeated.select("sig", "c"), "sig"), "repeated")
    of = rows.groupBy("sig", "c").agg(F.max("node").alias("z"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("h"), F.max(F.when(F.col("node") == F.col("c"), F.col("n"))).alias("n_c"))
    one = of.groupBy("c", "z", "k", "h").agg(F.min("sig").alias("sig"), F.max("n_c").alias("n_c"))
    shared = written(rows.drop("c").join(one.select("sig", "c", "n_c", "k"), "sig"), "shared")
    drop_written(rows)
    return shared


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``rows`` (sig, part, node, ...) whose signature and part have nodes of several components, with their own as comp."""
    now = rows.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = now.groupBy("sig", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("sig", "part")
    return now.join(mixed, ["sig", "part"])


def _links(texts: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose sets are similar, from the nodes' texts."""
    both = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return written(both.mapInArrow(lambda it: _verified(it, n, num, den), "a long, b long"), "links")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Grams that each set of ``x`` shares with each of ``y``."""
    both = np.zeros((len(x), len(y)), np.int64)
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    cells = []
    for sets in (x, y):
        row, grams = np.repeat(np.arange(len(sets)), [len(g) for g in sets]), np.concatenate(sets)
        col = np.minimum(np.searchsorted(common, grams), max(0, len(common) - 1))
        shared = common[col] == grams if len(common) else np.zeros(len(grams), bool)
        order = np.argsort(col[shared], kind="stable")
        cells.append((row[shared][order], col[shared][order]))
    for at in range(0, len(common), LINK_COLUMNS):
        parts = []
        for (row, col), sets in zip(cells, (x, y), strict=True):
            lo, hi = np.searchsorted(col, (at, at + LINK_COLUMNS))
            part = np.zeros((len(sets), min(LINK_COLUMNS, len(common) - at)), np.float32)
            part[row[lo:hi], col[lo:hi] - at] = 1
            parts.append(part)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


def _linked(group: pa.Table, n: int, num: int, den: int) -> pa.Table:
    """node, links: the documents of all sets in the other block (or of the others in the same) that are similar to each set."""
    node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
    sets = [_unzipped_set(d.as_py(), n) for d in group.column("data")]
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block != block.min()) if group.column("lo")[0] != group.column("hi")[0] else first
    if not len(second):
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    both = _overlaps([sets[k] for k in first], [sets[k] for k in second])
    size = np.array([len(g) for g in sets])
    near = both * den >= (size[first][:, None] + size[second][None, :] - both) * num
    if second is first:
        np.fill_diagonal(near, False)
        return pa.table({"node": node[first], "links": near @ copies[first]})
    return pa.table({"node": np.concatenate([node[first], node[second]]), "links": np.concatenate([near @ copies[second], copies[first] @ near])})


def _link_counts(members: DataFrame, reps: DataFrame, labels: DataFrame, held_texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """key, n_links for every set with grams: the other documents that are similar to one with this set.

    All links are inside components (``labels``: node, comp), so each block of
    a component's sets meets each other block once, and only counts come out.
    """
    copies = members.filter("n > 0").groupBy("key").agg(F.count("*").alias("copies"))
    classes = written(copies.join(reps.select("key", "node"), "key"), "copies")
    nodes = labels.join(classes, "node").select("node", "comp", "copies")
    large = labels.groupBy("comp").agg(F.ceil(F.count("*") / LINK_BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    nodes = nodes.join(F.broadcast(large), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # at most a row a LINK_BLOCK sets
    nodes = nodes.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(held_texts, "node")
    dealt = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "comp", "copies", "block", "data", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = dealt.groupBy("comp", "lo", "hi").applyInArrow(lambda group: _linked(group, n, num, den), "node long, links long")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    return classes.join(linked, "node", "left").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def class_links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with set size and set key, one row a distinct set, links between distinct sets).

    The links connect exactly the sets that similarity (intersection times
    ``den`` at least union times ``num``) connects; they aren't all similar
    pairs. :func:`ngram_join` with ``count_links`` counts all of these.
    """
    return _class_links(docs, n, num, den)[:3]


def _class_links(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What :func:`class_links` gives, and the compressed texts of the sets that share signatures (node, data)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    survey = written(texts.select("doc_id", "text").mapInArrow(lambda it: _survey(it, n), DOC_AND_COUNT), "survey")
    members = survey.filter("key is not null").select("doc_id", "n", "key")
    often = survey.filter("key is null").groupBy("gram").agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= FREQUENT)
    known = often.orderBy(F.col("n_docs").desc(), "gram").limit(KNOWN).toPandas()
    grams = known["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    held = docs.sparkSession.sparkContext.broadcast((grams[order], known["n_docs"].to_numpy(np.int64)[order]))  # at most KNOWN grams
    found = texts.mapInArrow(lambda it: _index(it, n, num, den, *held.value), "key binary, doc_id long, row long, n long, sigs array<long>, bits array<long>, long_bits array<long>")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    reps = found.groupBy("key").agg(least.alias("least"), *(F.first(c).alias(c) for c in ("n", "sigs", "bits", "long_bits")))
    reps = written(reps.select("key", "least.doc_id", "least.row", "n", "sigs", "bits", "long_bits", F.monotonically_increasing_id().alias("node")), "reps")

    lookup, near_size = texts.select("row", "text"), _near_size(F.col("n_a"), F.col("n_b"), num, den)
    shared = _shared(reps)
    star = shared.filter("node != c").select(F.col("c").alias("a"), F.col("node").alias("b"), F.col("n_c").alias("n_a"), F.col("n").alias("n_b")).filter(near_size)
    star = written(_candidates(star.select("a", "b").distinct(), reps, num, den), "near")
    held_texts = _texts_of(lookup, reps.select("node", "row").join(_ends(star), "node"))
    links = _links(held_texts, star, n, num, den)
    labels = components(links)

    # sets of a signature whose sizes may be similar meet in a part: sizes up to a quotient of den / num, each set in its own part and the next
    part = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num) if num < den else 1.0) + 1e-9).cast("int")
    rows = shared.filter("k > 2").select("sig", "node", "n", F.explode(F.array(part, part + 1)).alias("part"), part.alias("own"))
    rows = written(_open(rows, labels), "open")
    drop_written(shared)
    order = F.struct(F.xxhash64("node", "sig", "part").alias("h"), "node", "n", "comp")
    one = rows.groupBy("sig", "part", "comp").agg(F.min(order).alias("one"))
    first = rows.groupBy("sig", "part").agg(F.min(order).alias("first"))
    again = one.join(first, ["sig", "part"]).filter("comp != first.comp").select(F.least("one.node", "first.node").alias("a"), F.greatest("one.node", "first.node").alias("b"), F.col("one.n").alias("n_a"), F.col("first.n").alias("n_b"))
    again = again.filter(near_size).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    again = written(_candidates(again, reps, num, den), "again")
    more = _ends(again).join(_ends(star), "node", "left_anti")
    held_texts = held_texts.union(_texts_of(lookup, reps.select("node", "row").join(more, "node")))
    links = links.union(_links(held_texts, again, n, num, den))
    labels = components(links)

    before = rows
    rows = _open(rows, labels).join(reps.select("node", "bits", "long_bits"), "node").select("sig", "part", "own", "node", "comp", "n", "bits", "long_bits")
    rows = written(rows, "left")
    drop_written(before)
    sizes = rows.groupBy("sig", "part", "comp").agg(F.count("*").alias("k"))
    most = sizes.groupBy("sig", "part").agg(F.max(F.struct("k", "comp"))["comp"].alias("most"))
    x, y = (rows.toDF("sig", "part", *(f"{c}_{s}" for c in rows.columns[2:])) for s in "xy")
    x = x.join(most, ["sig", "part"]).filter("comp_x != most")  # of two components one isn't the largest
    pairs = x.join(y, ["sig", "part"]).filter("comp_x != comp_y and (comp_y = most or node_x < node_y) and (own_x = part or own_y = part)").filter(_may_be_near(num, den))
    pairs = pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    done = star.union(again)
    pairs = written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    drop_written(rows)
    more = _ends(pairs).join(_ends(done), "node", "left_anti")
    held_texts = held_texts.union(_texts_of(lookup, reps.select("node", "row").join(more, "node")))
    return members, reps, links.union(_links(held_texts, pairs, n, num, den)), held_texts


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, count_links: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id that similarity leads to, its own included).

    Documents without words, or with a null text, link with nothing; repeated
    rows and equal sets are one class; null ids get the component of their
    class, and links lead through them; other columns are ignored; an empty table
    gives no rows.

    With ``count_links`` also n_links, the number of other rows that are similar
    to the document, all pairs counted; it takes time with the square of a component.
    """
    members, reps, links, held_texts = _class_links(docs, n, num, den)
    connected = components(links)
    labels = reps.join(connected, "node", "left").select("key", "doc_id", F.coalesce("comp", "node").alias("comp"))
    labels = written(labels, "labels")
    least = labels.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_key = labels.join(least, "comp").select("key", "component_id")
    if count_links:
        of_key = of_key.join(_link_counts(members, reps, connected, held_texts, n, num, den), "key")
    of_key = written(of_key, "classes")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return members.join(of_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *counted)
