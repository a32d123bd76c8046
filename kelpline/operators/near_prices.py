"""The best of many records that differ in price alone: the score grows with how alike prices are, so the best is next to the asked price in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Price of a record that has none. Scores are compared by so many digits.
UNKNOWN, DIGITS = -1.0, 9
#: Pairs whose scores a task holds at once.
TILE_PAIRS = 1 << 16


def blended(w: dict[str, float], jac: float, cross: float, apart: float, same: float, price: np.ndarray | None) -> np.ndarray:
    """``functions.rules.score_features`` of a pair without two models, step by step as there; without ``price`` where one is unknown."""
    total = w["jac"] + w["cross"] + w["brand"] + (w["price"] if price is not None else 0.0)
    part = w["price"] * price if price is not None else 0.0
    return np.maximum(0.0, (w["jac"] * jac + w["cross"] * cross + w["brand"] * same + part) / total - w["num"] * apart)


def steps_of(score: np.ndarray) -> np.ndarray:
    """Scores as whole numbers of their last digit that counts."""
    return np.rint(score * 10.0**DIGITS).astype(np.int64)


def best_prices(asked: np.ndarray, prices: np.ndarray, features: tuple[float, float, float, float], w: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Score of the best for each asked price, and its place in ``prices``, of equals the first."""
    known = prices != UNKNOWN
    score, place = np.full(len(asked), -1.0), np.zeros(len(asked), np.int64)
    bare = float(blended(w, *features, None))
    if not known.all():
        score[:], place[:] = bare, int(np.argmin(known))
    score[asked == UNKNOWN], place[asked == UNKNOWN] = bare, 0  # to a record without a price all are equally like, so the first is the best
    at = np.flatnonzero(asked != UNKNOWN)
    if not known.any() or not len(at):
        return score, place
    ranks = np.flatnonzero(known)
    order = ranks[np.argsort(prices[ranks], kind="stable")]
    line, p = prices[order], asked[at]
    beside = np.searchsorted(line, p)

    def of(k: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = line[np.clip(k, 0, len(line) - 1)]
        return np.where((k >= 0) & (k < len(line)), blended(w, *features, np.minimum(p, q) / np.maximum(p, q)), -1.0)

    low, high = of(beside - 1, p), of(beside, p)
    top = np.maximum(low, high)
    most, found = steps_of(top), np.full(len(at), len(prices), np.int64)
    for start, way in ((beside - 1, -1), (beside, 1)):
        open_rows, k = np.arange(len(at)), start.copy()
        while len(open_rows):  # as far as scores are equal by their digits
            s = of(k[open_rows], p[open_rows])
            open_rows = open_rows[(s >= 0) & (steps_of(s) == most[open_rows])]
            found[open_rows] = np.minimum(found[open_rows], order[k[open_rows]])
            k[open_rows] += way
    better = (most > steps_of(score[at])) | ((most == steps_of(score[at])) & (found < place[at]))
    score[at[better]], place[at[better]] = top[better], found[better]
    return score, place


def best_rows(threshold: float, w: dict[str, float], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (name, group, asked, prices, others, jac, cross, apart, same) to group, price, score, other; rows of one ``name`` that follow each other are one answer."""

    def out(group: str, asked: np.ndarray, score: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        kept = score >= threshold
        n = int(kept.sum())
        return pa.RecordBatch.from_arrays([pa.array([group] * n, pa.string()), pa.array(asked[kept]), pa.array(score[kept]), pa.array(list(other[kept]), kind)], ["group", "price", "score", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = None, None
        for batch in batches:
            columns = [batch.column(c) for c in range(9)]
            for k in range(batch.num_rows):
                asked, prices = (columns[c][k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                score, place = best_prices(asked, prices, tuple(columns[c][k].as_py() for c in range(5, 9)), w)
                other = np.array(columns[4][k].as_py(), object)[place]
                own = columns[0][k].as_py()
                if own != name:
                    if held is not None:
                        yield out(*held)
                    held, name = (columns[1][k].as_py(), asked, score, other), own
                    continue
                a, b = steps_of(held[2]), steps_of(score)
                better = b > a
                ties = np.flatnonzero(a == b)
                better[ties] = (other[ties] < held[3][ties]).astype(bool)
                held[2][better], held[3][better] = score[better], other[better]
        if held is not None:
            yield out(*held)

    return run


def rounded_up(score: float, digits: int) -> int:
    """A score's whole number of last digits, halves rounded up as Spark's ``round`` does."""
    return int((Decimal(repr(float(score))) * 10**digits).quantize(Decimal(1), ROUND_HALF_UP))


def best_later(ids: np.ndarray, asked: np.ndarray, others: np.ndarray, prices: np.ndarray, features: tuple[float, float, float, float], w: dict[str, float], threshold: float, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id the score, in whole numbers of its last of ``digits``, of the best among those of ``others`` (sorted) that come after it, and its place, the first of equals; -1 if none reaches ``threshold``."""
    most, place = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
    bare = float(blended(w, *features, None))
    step = max(1, TILE_PAIRS // max(1, len(others)))
    for low in range(0, len(ids), step):
        p = asked[low : low + step, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = blended(w, *features, np.minimum(p, prices) / np.maximum(p, prices))
        score[(p == UNKNOWN) | (prices == UNKNOWN)[None, :]] = bare
        score[others[None, :] <= ids[low : low + step, None]] = -1.0
        top = score.max(axis=1, initial=-1.0)
        rows = np.flatnonzero(top >= threshold)
        scaled = top[rows] * 10.0**digits
        steps = np.floor(scaled + 0.5).astype(np.int64)
        for k in np.flatnonzero(np.abs(scaled + 0.5 - np.rint(scaled + 0.5)) < 1e-6):
            steps[k] = rounded_up(top[rows[k]], digits)
        least = (steps - 0.5) / 10.0**digits
        score = score[rows]
        found = (score >= np.maximum(least - 1e-12, threshold)[:, None]).argmax(axis=1)
        for k in np.flatnonzero(score[np.arange(len(rows)), found] <= least + 1e-12):  # on the border
            found[k] = next(at for at in range(int(found[k]), len(others)) if score[k, at] >= threshold and rounded_up(score[k, at], digits) == steps[k])
        most[low + rows], place[low + rows] = steps, found
    return most, place


def later_rows(threshold: float, w: dict[str, float], digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (name, asked (id, price), others (id, price; sorted), jac, cross, apart, same) to id, score, other; rows of one ``name`` that follow each other are one answer."""

    def out(ids: np.ndarray, most: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        kept = most >= 0
        return pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(most[kept] / 10.0**digits), pa.array(other[kept])], ["id", "score", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = None, None
        for batch in batches:
            columns = [batch.column(c) for c in range(7)]
            for k in range(batch.num_rows):
                sides = [columns[c][k].values for c in (1, 2)]
                (ids, asked), (others, prices) = ([s.field(i).to_numpy(zero_copy_only=False) for i in range(2)] for s in sides)
                most, place = best_later(ids, asked, others, prices, tuple(columns[c][k].as_py() for c in range(3, 7)), w, threshold, digits)
                other, own = others[place], columns[0][k].as_py()
                if own != name:
                    if held is not None:
                        yield out(*held)
                    held, name = (ids, most, other), own
                    continue
                better = (most > held[1]) | ((most == held[1]) & (other < held[2]))
                held[1][better], held[2][better] = most[better], other[better]
        if held is not None:
            yield out(*held)

    return run
