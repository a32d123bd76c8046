"""The best by nearest prices against all pairs, and without rows by the square of a title."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_growth import most_rows

from kelpline.fixed import PAIR_WEIGHTS
from kelpline.operators import matching, near_prices
from kelpline.operators.near_prices import UNKNOWN, best_prices, blended, steps_of
from kelpline.plans.resolution import NEAR_FROM


@pytest.mark.parametrize("seed", range(4))
def test_best_prices(seed):
    """Unknown prices, many equal ones, and prices that nine digits don't tell apart."""
    rng = np.random.default_rng(seed)
    pool = [np.round(rng.uniform(90, 110, 40), 1), 100 + rng.integers(0, 9, 40) * 1e-9, np.array([902.5, 912.0, 921.6])][: seed + 1 if seed < 3 else 2]
    asked = np.unique(np.append(rng.choice(np.concatenate(pool), 25), UNKNOWN))
    for prices in (rng.choice(np.append(np.concatenate(pool), [UNKNOWN] * (seed % 2 * 20)), 60), np.full(3, UNKNOWN), np.array([UNKNOWN, 100.0, 101.0]), np.array([101.0, UNKNOWN])):
        score, place = best_prices(asked, prices, (1 / 3, 0.0, 0.0, 1.0), PAIR_WEIGHTS)
        for p, s, k in zip(asked, score, place, strict=True):
            every = np.array([float(blended(PAIR_WEIGHTS, 1 / 3, 0.0, 0.0, 1.0, np.float64(min(p, q) / max(p, q)) if p > 0 and q > 0 else None)) for q in prices])
            steps = steps_of(every)
            assert steps_of(np.array([s]))[0] == steps.max() and k == int(np.argmax(steps))


@pytest.mark.parametrize("cut", [50, 4096])
def test_a_title_at_many_prices(spark, monkeypatch, cut):
    """1,500 records of a title with 1,500 others: two million pairs, of which no row is made."""
    monkeypatch.setattr(matching, "GROUP_PRICES", cut)
    tokens = F.array(F.lit("old"), F.lit("fan"))
    r = lambda shift: F.struct(F.lit("old fan").alias("title_norm"), F.lit(None).cast("string").alias("model_no"), F.array().cast("array<string>").alias("title_model_tokens"), (F.col("id") * 2 + shift).cast("double").alias("price"), F.lit("acme").alias("brand"), tokens.alias("tokens"), F.array().cast("array<string>").alias("numbers"))
    side = lambda low, shift: spark.range(low, low + 1500).select("id", F.lit("b").alias("block"), r(shift).alias("r"), F.lit(False).alias("exact"))
    left, right = matching.keyed(side(0, 100_001)), matching.keyed(side(50_000, 0))
    a, b = matching.classes_of(left), matching.classes_of(right).join(right.groupBy("key").agg(F.min("id").alias("ids")), "key")
    near = matching.best_blended(a, b, NEAR_FROM)
    got = {r["id"]: r["other"] for r in left.join(near, "key").select("id", "other").collect()}
    near.collect()
    assert most_rows(near) < 100_000
    # nine digits mostly don't tell the nearest price above from the one below, so the least id counts
    p, q = np.arange(1500)[:, None] * 2.0 + 100_001, np.arange(50_000, 51_500)[None, :] * 2.0
    every = steps_of(blended(PAIR_WEIGHTS, 1.0, 0.0, 0.0, 1.0, np.minimum(p, q) / np.maximum(p, q)))
    assert got == {k: 50_000 + int(v) for k, v in enumerate(every.argmax(1))}


@pytest.mark.parametrize("cut", [300, 1 << 16])
def test_best_later(monkeypatch, cut):
    """Scores that five digits don't tell apart, halves of the last digit, unknown prices and a threshold."""
    monkeypatch.setattr(near_prices, "TILE_PAIRS", cut)
    w = {"jac": 1.0, "cross": 0.0, "price": 1.0, "brand": 0.0, "num": 0.0}
    prices = np.array([100_000.0, 99_999.0, 99_998.0, 90_000.0, UNKNOWN, 100_000.0, 99_997.0, 50.0] * 12)
    ids, others = np.arange(96) * 3, np.arange(96) * 2
    most, place = near_prices.best_later(ids, prices, others, prices[::-1], (0.5, 0.0, 0.0, 1.0), w, 0.6, 5)
    for i, p, steps, k in zip(ids, prices, most, place, strict=True):
        every = [float(blended(w, 0.5, 0.0, 0.0, 1.0, np.float64(min(p, q) / max(p, q)) if p > 0 and q > 0 else None)) for q in prices[::-1]]
        want = min(((-near_prices.rounded_up(s, 5), at) for at, s in enumerate(every) if others[at] > i and s >= 0.6), default=(1, 0))
        assert (steps, k) == (-want[0], want[1])
    assert near_prices.rounded_up(0.617645, 5) == 61765 and 0 < (most >= 0).sum() < 96


def test_best_after_of_a_title_at_many_prices(spark):
    """2,000 records of one title: four million pairs, of which no row is made."""
    tokens = F.array(F.lit("old"), F.lit("fan"))
    r = F.struct(F.lit("old fan").alias("title_norm"), F.lit(None).cast("string").alias("model_no"), F.array().cast("array<string>").alias("title_model_tokens"), (F.col("id") * 7919 % 2000 + 1000).cast("double").alias("price"), F.lit("acme").alias("brand"), tokens.alias("tokens"), F.array().cast("array<string>").alias("numbers"))
    rows = spark.range(2000).select("id", F.lit("b").alias("block"), r.alias("r"), F.lit(False).alias("exact"))
    df = matching.best_after(rows, 0.58)
    got = {x["id"]: x["other"] for x in df.collect()}
    assert most_rows(df) < 100_000
    price = np.arange(2000) * 7919 % 2000 + 1000.0
    for i in range(0, 1999, 37):
        every = [near_prices.rounded_up(float(s), 5) for s in blended(PAIR_WEIGHTS, 1.0, 0.0, 0.0, 1.0, np.minimum(price[i], price[i + 1 :]) / np.maximum(price[i], price[i + 1 :]))]
        assert got[i] == i + 1 + int(np.argmax(every))
