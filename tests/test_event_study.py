"""Event study on made units: tiers, edge cases, and the interval against resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.operators.event_study import effects, hashed, indexed_units, judged, log_variance, natural_swing, placebo_events, placed, select_controls, window_pool

UNITS = "unit string, family string, product_type string, broad string, launch_mi int, first_mi int, total long"
COUNTS = "unit string, mi int, n long, stars long"
EVENTS = "event_id string, unit string, event_type string, m0 int"
MARKS = "unit string, event_type string, at int"
LAST = 60


def units_of(spark, rows):
    return spark.createDataFrame([(u, f, t, b, launch, 0, 600) for u, f, t, b, launch in rows], UNITS)


def counts_of(spark, levels, first=0):
    return spark.createDataFrame([(u, m, n if m <= 30 else after, 0) for u, n, after in levels for m in range(first, LAST + 6)], COUNTS)


def controls_of(spark, units, counts, events, marks=()):
    pool = window_pool(counts, spark.createDataFrame(list(marks), MARKS), LAST)
    rows = placed(spark.createDataFrame(events, EVENTS), pool, units)
    return rows, select_controls(rows, pool, units)


def picked(controls):
    return [(r.control, r.tier) for r in controls.orderBy("event_id", "place").collect()]


EVENT = [("e", "a", "low_rating", 30)]


def test_strict_tier_and_its_bars(spark):
    units = units_of(spark, [("a", "f", "t", "b", 0), ("kin", "f", "t", "b", 0), ("near", None, "t", "b", 24), ("nul", None, "t", "b", None), ("far", "g", "t", "b", 25), ("big", "h", "t", "b", 0), ("spoiled", "i", "t", "b", 0), ("other", "j", "u", "b", 0), ("late", "k", "t", "b", 0), ("tie", "l", "t", "b", 3)])
    units = units.withColumn("first_mi", F.when(F.col("unit") == "late", 14).otherwise(F.col("first_mi")))
    levels = [(u, 20, 20) for u in ("a", "kin", "nul", "far", "spoiled", "other", "late", "tie")] + [("near", 25, 25), ("big", 90, 90)]
    _, controls = controls_of(spark, units, counts_of(spark, levels), EVENT, [("spoiled", "low_rating", 33), ("tie", "low_rating", 34), ("tie", "sibling_launch", 30)])
    # late is within half the event's age, so only first_mi 16 or more would bar it
    assert picked(controls) == [("late", "strict"), ("nul", "strict"), ("tie", "strict"), ("near", "strict")]


def test_relaxed_and_broad_tiers(spark):
    names = ["b1", "b2", "b3"]
    strict = [("a", "f", "t", "b", 0), ("s1", "g", "t", "b", 0), ("s2", "h", "t", "b", 0)]
    levels = [("a", 20, 20), ("s1", 20, 20), ("s2", 21, 21), ("r", 90, 90)] + [(b, 20, 20) for b in names]
    relaxed = units_of(spark, [*strict, ("r", "i", "t", "b", 48)] + [(b, b, "u", "b", 0) for b in names])
    _, controls = controls_of(spark, relaxed, counts_of(spark, levels), EVENT)
    assert picked(controls) == [("s1", "relaxed"), ("s2", "relaxed"), ("r", "relaxed")]
    broad = units_of(spark, [*strict, ("r", "i", "t", "b", 49)] + [(b, b, "u", "b", 0) for b in names])
    _, controls = controls_of(spark, broad, counts_of(spark, levels), EVENT)
    assert picked(controls) == [(c, "broad category") for c in ("b1", "b2", "b3", "s1", "s2")]


def test_at_most_ten_controls_and_a_verdict(spark):
    rows = [("a", "f", "t", "b", 0)] + [(f"c{k:02}", f"g{k}", "t", "b", 0) for k in range(14)]
    units, counts = units_of(spark, rows), counts_of(spark, [("a", 200, 20)] + [(r[0], 200 + k, 200 + k) for k, r in enumerate(rows[1:])])
    events, controls = controls_of(spark, units, counts, [*EVENT, ("early", "a", "low_rating", 1), ("late", "a", "low_rating", 59), ("none", None, "low_rating", 30), ("no_month", "a", "low_rating", None)])
    assert [c for c, _ in picked(controls)] == [f"c{k:02}" for k in range(10)]
    null = spark.createDataFrame([(3, True, x / 100) for x in range(-50, 51)], "event_window int, tested boolean, log_effect double")
    got = judged(effects(events, controls).withColumn("event_window", F.lit(3)), natural_swing(null)).collect()
    assert [r.event_id for r in got] == ["e"]
    assert got[0].verdict == "moved" and got[0].n_controls == 10 and abs(got[0].effect - (20.5 / 200.5 - 1)) < 0.01 and got[0].lo < got[0].effect < got[0].hi < 0
    assert got[0].p == pytest.approx(1 / 102) and not got[0].near_zero_after


def test_too_little_data(spark):
    units = units_of(spark, [("a", "f", "t", "b", 0), ("c", "g", "t", "b", 0)])
    events, controls = controls_of(spark, units, counts_of(spark, [("a", 20, 20), ("c", 20, 20)]), EVENT)
    null = natural_swing(effects(events, controls).withColumn("event_window", F.lit(3)))
    assert null.count() == 0
    row = judged(effects(events, controls).withColumn("event_window", F.lit(3)), null).first()
    assert (row.verdict, row.n_controls, row.tier, row.effect, row.p) == ("not_enough_data", 1, "broad category", None, None)
    empty = controls_of(spark, units.limit(0), spark.createDataFrame([], COUNTS), EVENT)[1]
    assert empty.count() == 0


def test_p_counts_ties_and_both_ends(spark):
    null = spark.createDataFrame([(3, True, x) for x in (0.1, -0.1, 0.2, 0.2, -0.3)], "event_window int, tested boolean, log_effect double")
    rows = spark.createDataFrame([(3, True, x, 0.01, 50, 3, 50, 3) for x in (0.0, 0.1, 0.15, -0.2, 0.3, 0.4)], "event_window int, tested boolean, log_effect double, boot_var double, pre long, pre_months int, post long, post_months int")
    got = {r.log_effect: round(r.p * 6) for r in judged(rows, natural_swing(null)).collect()}
    assert got == {0.0: 6, 0.1: 6, 0.15: 4, -0.2: 4, 0.3: 2, 0.4: 1}


def test_variance_is_what_resampling_tends_to(spark):
    rng = np.random.default_rng(5)
    cases = [(0, 3), (1, 3), (6, 12), (30, 3), (99, 12), (101, 12), (4000, 3)]
    got = {(r.t, r.m): r.v for r in spark.createDataFrame(cases, "t long, m int").withColumn("v", log_variance(F.col("t"), F.col("m"))).collect()}
    for t, m in cases:
        assert got[t, m] == pytest.approx(np.log(rng.poisson(t, 400_000) / m + 0.5).var(), rel=0.02, abs=1e-12)
    exact, near = (spark.range(1).select(log_variance(F.lit(x), F.lit(6))).first()[0] for x in (100, 100.001))
    assert exact == pytest.approx(near, rel=1e-3)


def test_made_dates_keep_away_from_marks(spark):
    units = units_of(spark, [(f"u{k}", "f", "t", "b", 0) for k in range(40)]).withColumn("total", F.when(F.col("unit") == "u0", 59).otherwise(600))
    marks = spark.createDataFrame([("u1", "low_rating", 30), ("u2", "refurbished", 30)], MARKS)
    rows = placebo_events(units, marks, LAST, 4000, "A").collect()
    assert len({r.event_id for r in rows}) == len(rows) > 3500 and {r.unit for r in rows} == {f"u{k}" for k in range(1, 40)}
    assert not any((r.unit == "u1" and 27 <= r.m0 <= 33) or (r.unit == "u2" and 18 <= r.m0 <= 42) for r in rows)
    assert all((12 <= r.m0 <= 48) if r.event_type == "sibling_launch" else (3 <= r.m0 <= 57) for r in rows)


def test_units_are_numbered_without_gaps(spark):
    got = sorted(r.ix for r in indexed_units(units_of(spark, [(f"u{k}", "f", "t", "b", 0) for k in range(700)])).collect())
    assert got == list(range(700))
    u = spark.range(5000).select(hashed(F.lit("x"), F.col("id")).alias("u"))
    low, high, mean = u.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.02


@pytest.mark.parametrize(("seed", "block"), [(1, 2), (3, 64)])
def test_nearest_controls_equal_those_of_all_candidates(spark, seed, block):
    """Units of few volumes, so that many are as near: block by block against every unit of the type and month."""
    import math
    import random

    draw = random.Random(seed)
    rows = [(f"u{k:03}", draw.choice([None, "f", "g"]), draw.choice("tttu"), "b", draw.choice([0, 10, 30, None])) for k in range(90)]
    units = units_of(spark, rows).withColumn("first_mi", F.when(F.col("unit") < "u030", 14).otherwise(F.col("first_mi")))
    counts = counts_of(spark, [(r[0], draw.choice([1, 2, 2, 3, 9]), 5) for r in rows])
    asked = [(f"e{k}", f"u{k:03}", draw.choice(["low_rating", "sibling_launch"]), 30) for k in range(0, 90, 2)]
    marks = spark.createDataFrame([(f"u{k:03}", "low_rating", 31) for k in range(5, 90, 9)], MARKS)
    pool = window_pool(counts, marks, LAST).cache()
    events = placed(spark.createDataFrame(asked, EVENTS), pool, units)
    got = {(r["event_id"], r["place"]): (r["control"], r["tier"], r["gap"]) for r in select_controls(events, pool, units, block).collect()}
    there = pool.filter("pre > 0 and not spoiled").join(units.drop("total"), "unit").collect()
    want = {}
    for e in events.collect():
        near, broad = [], []
        for c in there:
            if (c["event_type"], c["m0"]) != (e["event_type"], e["m0"]) or c["unit"] == e["unit"] or (c["family"] is not None and c["family"] == e["family"]):
                continue
            gap = round(abs(math.log(c["pre"] / c["pre_months"] + 0.5) - math.log(e["pre"] / e["pre_months"] + 0.5)), 9)
            apart = 0 if None in (c["launch_mi"], e["launch_mi"]) else abs(c["launch_mi"] - e["launch_mi"])
            if apart > 48 or gap > round(math.log(5), 9) or abs(c["first_mi"] - e["first_mi"]) > max(12, 0.5 * (e["m0"] - e["first_mi"])):
                continue
            own = (gap, c["unit"], apart <= 24 and gap <= round(math.log(3), 9))
            broad.append(own)
            near += [own] if c["product_type"] == e["product_type"] else []
        strict = [x for x in near if x[2]]
        tier, kept = ("strict", strict) if len(strict) >= 3 else ("relaxed", near) if len(near) >= 3 else ("broad category", broad)
        want |= {(e["event_id"], k + 1): (u, tier, g) for k, (g, u, _) in enumerate(sorted(kept)[:10])}
    assert got == want and {t for _, t, _ in want.values()} >= {"strict"}


def test_an_event_meets_some_blocks_not_all_units(spark):
    """25 and 5,000 units of one type, month and volume band: the pairs that are made of an event stay within a few blocks."""
    from kelpline.operators import event_study

    made = {}
    for n in (25, 5000):
        rows = spark.range(n).select(F.format_string("u%05d", "id").alias("unit"), F.concat(F.lit("f"), "id").alias("family"), F.lit("t").alias("product_type"), F.lit("b").alias("broad"), F.lit(0).alias("launch_mi"), F.lit(0).alias("first_mi"))
        pool = rows.select("unit", F.lit("low_rating").alias("event_type"), F.lit(30).alias("m0"), (F.lit(30) + F.crc32("unit") % 40).alias("pre"), F.lit(3).alias("pre_months"), F.lit(30).alias("post"), F.lit(3).alias("post_months"), F.lit(False).alias("spoiled"))
        events = placed(rows.filter("cast(substring(unit, 2, 5) as int) % 5 = 0").select(F.col("unit").alias("event_id"), "unit", F.lit("low_rating").alias("event_type"), F.lit(30).alias("m0")), pool, rows)
        kept = event_study.candidates(events, pool, rows, {"near": "product_type"})
        made[n] = kept.count() / events.count()
        assert select_controls(events, pool, rows).count() == 10 * events.count()
    assert made[25] <= 24 and made[5000] <= 4 * event_study.BLOCK
