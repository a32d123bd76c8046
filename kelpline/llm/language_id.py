"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, all that isn't a letter becomes one blank, and the one
to three characters at every place are hashed to buckets. Training adds up
whole counts of all labelled texts: a task sends one row a language and bucket.
The matrix of log-probabilities, of bounded size, is broadcast; batches of
documents are scored at once by sums of its rows over all their grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets at most, and cells of the matrix at most: with more languages there are fewer buckets.
BITS, CELL_BITS = 16, 22
#: More values of the label than this aren't languages.
MOST_LANGUAGES = 4096
#: Lengths of n-grams.
LENGTHS = (1, 2, 3)
#: What a bucket is taken to have been seen besides its count.
SMOOTHING = 0.5
#: Characters that are worked on at once; longer texts go in pieces that overlap.
AT_ONCE = 1 << 18
#: Languages whose counts a task holds at once.
HELD = 32
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


class LanguageModel(NamedTuple):
    """Languages in sorted order, a row of log-probabilities a bucket, and the languages' log-priors."""

    languages: tuple[str, ...]
    by_bucket: np.ndarray
    priors: np.ndarray
    bits: int


def letters(text: str | None) -> str:
    """Lower-cased words of letters between single blanks, with a blank before and after; empty without letters."""
    plain = _NO_LETTER.sub(" ", (text or "").lower())
    if not plain.replace(" ", "").isalpha():  # numerals such as ² and ½ are word characters, too
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    plain = plain.strip()
    return f" {plain} " if plain else ""


def _pieces(plain: str) -> Iterator[np.ndarray]:
    """Code points of a text in pieces; each but the first begins with the last two of the one before."""
    reach = max(LENGTHS) - 1
    for at in range(0, len(plain), AT_ONCE):
        yield np.frombuffer(plain[max(0, at - reach) : at + AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(plain: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text from :func:`letters`, piece by piece; each gram once for each place."""
    reach = max(LENGTHS) - 1
    for number, c in enumerate(_pieces(plain)):
        old = reach if number else 0
        out = []
        for n in LENGTHS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h + c[i : len(c) - n + 1 + i]) * _A
            h = (h ^ (h >> _C)) * _B
            out.append((h >> np.uint64(64 - bits)).astype(np.int64)[max(0, old - n + 1) :])
        yield np.concatenate(out)


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n of a task's texts: rows of counts, sent when too many languages are held and at the end."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])], ["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if lang not in held and len(held) >= HELD:
                yield from flush()
            counts = held.setdefault(lang, np.zeros(1 << bits, np.int64))
            for index in grams(letters(text.as_py()), bits):
                counts += np.bincount(index, minlength=1 << bits)
    yield from flush()


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 on division by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def train_languages(docs: DataFrame, bits: int = BITS) -> LanguageModel:
    """The model learnt from ``text`` and non-null ``lang`` of all of ``docs``; give it those rows only that it may see.

    Every text counts, repeated ones each time; one without letters adds to
    its language's prior alone. Without any labelled row the model knows no
    language. More than ``MOST_LANGUAGES`` labels raise ValueError.
    """
    known = docs.filter("lang is not null").select("text", "lang")
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    languages = tuple(sorted(r["lang"] for r in sizes))
    if not languages:
        return LanguageModel((), np.zeros((1, 0)), np.zeros(0), 0)
    bits = min(bits, CELL_BITS - max(0, (len(languages) - 1).bit_length()))
    sums = known.mapInArrow(lambda it: _count(it, bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((1 << bits, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    got = sums.toArrow()  # at most 2^CELL_BITS rows
    if got.num_rows:
        column = np.array([place[x] for x in got["lang"].combine_chunks().dictionary_encode().dictionary.to_pylist()])[got["lang"].combine_chunks().dictionary_encode().indices.to_numpy()]
        counts[got["bucket"].to_numpy(), column] = got["n"].to_numpy()
    counts += SMOOTHING
    rows = np.array([{r["lang"]: r["count"] for r in sizes}[lang] for lang in languages], float)
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(rows / rows.sum()), bits)


def scores(plain: list[str], model: LanguageModel) -> np.ndarray:
    """Log-probabilities, a row a text of :func:`letters` and a column a language, up to a constant a row."""
    out = np.tile(model.priors, (len(plain), 1))
    held: list[np.ndarray] = []
    owner: list[int] = []

    def add() -> None:
        """One sum over the rows of the matrix that the held grams name."""
        starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
        index = np.concatenate(held)
        for at in range(0, len(model.languages), HELD):
            part = np.add.reduceat(model.by_bucket[index, at : at + HELD], starts, axis=0, dtype=np.float64)
            np.add.at(out[:, at : at + HELD], owner, part)
        held.clear()
        owner.clear()

    size = 0
    for k, text in enumerate(plain):
        for index in grams(text, model.bits):
            held.append(index)
            owner.append(k)
            size += len(index)
            if size >= AT_ONCE:
                add()
                size = 0
    if held:
        add()
    return out


def _identify(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [letters(text.as_py()) for text in batch.column(0)]
        best, sure = np.full(len(plain), -1), np.zeros(len(plain))
        told = [k for k, p in enumerate(plain) if p] if model.languages else []
        if told:
            found = scores([plain[k] for k in told], model)
            best[told] = found.argmax(axis=1)
            sure[told] = 1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1)
        names = [UNKNOWN if b < 0 else model.languages[b] for b in best]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(sure)], [*batch.schema.names[1:], "lang_pred", "score"])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score, the language's probability among those known.

    A text that is null or has no letter, or any where no language is known, is
    ``und`` with score 0; of equal languages the first in sorted order wins.
    Whole texts count, long ones piece by piece. ``keep`` mustn't name
    ``_text``, ``lang_pred`` or ``score``.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    part = docs.select(F.col("text").alias("_text"), *keep)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    return part.mapInArrow(lambda it: _identify(it, LanguageModel(*held.value)), schema)
