"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are its words and pairs of words, and the same of the words'
shapes (case, digits, the signs after them, a word like the one before), hashed
to ``BITS`` bits; a feature's value is the root of its count over the root of
the number of all. A score is one sparse dot product, done document by document
where the texts lie. The model is fitted in one task on a bounded sample of
labelled rows, so only its weights, of fixed size, are broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_cache

BITS = 18
#: Bound of the labelled rows that the model is fitted on, those with the least hashes.
SAMPLE_ROWS = 8000
#: Passes over the sample, and the regularised leader's parameters.
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 0.02, 0.2
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 250_000
_RUNS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(word: str) -> str:
    """The word with runs of letters, digits and signs as classes."""
    out = []
    for run in _RUNS.findall(word):
        if run[0].isalpha():
            out.append("A" if len(run) > 1 and run.isupper() else "T" if run[0].isupper() else "a")
        else:
            out.append("0" if run[0].isdigit() else run[:3])
    return "".join(out)[:12]


class _Hashes(dict):
    """Two hashes of a word: of itself, lower-cased, and of its shape."""

    def __missing__(self, word: str) -> int:
        own = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        shape = zlib.crc32(b"\0" + _shape(word).encode("utf-8", "surrogatepass"))
        self[word] = both = own << 32 | shape
        return both


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> _C)) * _B
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features; there are none without words."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    known = worker_cache("quality words", _Hashes)
    if len(known) > CACHE_WORDS:
        known.clear()
    both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    own, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = np.concatenate([np.zeros(1, np.uint64), (own[1:] == own[:-1]).astype(np.uint64)])
    shape = shape + same * np.uint64(0x5BD1E995)
    grams = np.concatenate([own * _A, (own[:-1] * _A + own[1:]) * _A, shape * _B + np.uint64(1), (shape[:-1] * _B + shape[1:]) * _A + np.uint64(2)])
    index, count = np.unique(_mixed(grams, bits), return_counts=True)
    return index, np.sqrt(count / len(grams)).astype(np.float32)


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over (indexes, values, label); the last weight is the intercept's."""
    z, n, w = (np.zeros((1 << bits) + 1) for _ in range(3))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            i, x, y = examples[k]
            i, x = np.append(i, 1 << bits), np.append(x, np.float32(1))
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[i] = ni + g * g
    hit = np.abs(z) > L1
    w[hit] = -(z[hit] - np.sign(z[hit]) * L1) / ((BETA + np.sqrt(n[hit])) / ALPHA + L2)
    return w.astype(np.float32)


def _fit(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            examples.append((*features(text.as_py(), bits), label.as_py()))
    yield pa.RecordBatch.from_arrays([pa.array([fit_ftrl(examples, bits).tobytes()], pa.binary())], ["weights"])


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 on division by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learnt from labelled documents that aren't held out.

    At most ``sample_rows`` rows of ``labels`` are used, those with the least
    hash of the id. Null labels and ids are left out; an id with both labels
    counts twice, one that is repeated once a label, with its least text, so
    the rows to fit are bounded too; without any labelled row all weights are 0.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~is_held_out(F.col("doc_id")))
    sample = rows.distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "label").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows ids
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    one = texts.select("text", "label", F.xxhash64("doc_id").alias("by")).repartition(1).sortWithinPartitions("by", "label").select("text", "label")
    got = one.mapInArrow(lambda it: _fit(it, bits), "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dots = np.empty(batch.num_rows)
        for k, text in enumerate(batch.column(0)):
            i, x = features(text.as_py(), bits)
            dots[k] = weights[i] @ x + weights[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], [*batch.schema.names[1:], "score"])


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], bits: int = BITS) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score``, 0 to 1. An empty or null text has the intercept's score."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    part = docs.select(F.col("text").alias("_text"), *keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return part.mapInArrow(lambda it: _score(it, held.value, bits), schema)
