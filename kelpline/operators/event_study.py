"""Event studies: what a unit's monthly counts did around an event, against like units at the same time.

Tables, all with whole months as numbers (year * 12 + month - 1):

- counts: unit, mi, n, stars: one row a unit and month, no duplicates; months without reviews may be absent.
- units: unit, family, product_type, broad, launch_mi, first_mi, total. A null family has no relatives, a null launch_mi fits every launch.
- events: event_id, unit, event_type, m0. Null units or months find no window and get no result.
- marks: unit, event_type, at: months that spoil a unit as control of that kind of event.

Windows come from frames over a unit's dense months, so that an event or a control at any month is an equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import EVENT_WINDOWS
from .nearest import nearest_first
from .relational import cooled_down, settled

#: Tiers by largest launch distance in months and largest ratio of volumes; least and most controls; the least reviews before.
STRICT, RELAXED = (24, 3.0), (48, 5.0)
LEAST_CONTROLS, MOST_CONTROLS, LEAST_REVIEWS = 3, 10, 30
#: The least effect called a move, and a normal's 95 % point.
MOVE, Z95 = 0.15, 1.645
#: Units of a block that an event reads at once when it looks for controls.
BLOCK = 64
#: Poisson means up to which the variance of a log is summed exactly.
EXACT_MEAN = 100


def dense_counts(counts: DataFrame, last: int) -> DataFrame:
    """unit, first_mi, mi, n, stars with a row for every month from the unit's first to ``last``."""
    span = counts.groupBy("unit").agg(F.min("mi").alias("first_mi")).filter(F.col("first_mi") <= last)
    grid = span.withColumn("mi", F.explode(F.sequence("first_mi", F.lit(last))))
    return grid.join(counts, ["unit", "mi"], "left").fillna(0, ["n", "stars"])


def window_pool(counts: DataFrame, marks: DataFrame, complete: int) -> DataFrame:
    """unit, event_type, m0, pre, pre_months, post, post_months, spoiled: the windows of every unit at every month that has enough of them.

    Months before the unit's first or after ``complete`` don't count; each side needs half a window and two months at least.
    """
    dense = dense_counts(counts, complete)
    order = Window.partitionBy("unit").orderBy("mi")
    kinds = []
    for kind, w in EVENT_WINDOWS.items():
        pre, post = (F.coalesce(F.sum("n").over(order.rangeBetween(*frame)), F.lit(0)) for frame in ((-w, -1), (1, w)))
        before, after = F.least(F.lit(w), F.col("mi") - F.col("first_mi")), F.least(F.lit(w), F.lit(complete) - F.col("mi"))
        dense = dense.withColumns({f"pre{w}": pre, f"post{w}": post})
        kinds.append(F.struct(F.lit(kind).alias("event_type"), F.lit(max(2, w // 2)).alias("need"), F.col(f"pre{w}").alias("pre"), before.alias("pre_months"), F.col(f"post{w}").alias("post"), after.alias("post_months")))
    pool = dense.select("unit", F.col("mi").alias("m0"), F.inline(F.array(*kinds))).filter("pre_months >= need and post_months >= need").drop("need")
    return pool.join(spoiled_months(marks), ["unit", "event_type", "m0"], "left").withColumn("spoiled", F.coalesce("spoiled", F.lit(False)))


def spoiled_months(marks: DataFrame) -> DataFrame:
    """unit, event_type, m0: months within a window of a mark."""
    w = F.create_map(*(F.lit(x) for pair in EVENT_WINDOWS.items() for x in pair))[F.col("event_type")]
    return marks.select("unit", "event_type", F.explode(F.sequence(F.col("at") - w, F.col("at") + w)).alias("m0")).distinct().withColumn("spoiled", F.lit(True))


def placed(events: DataFrame, pool: DataFrame, units: DataFrame) -> DataFrame:
    """Events with their windows and their unit's attributes; those without a window are left out."""
    return events.join(pool.drop("spoiled"), ["unit", "event_type", "m0"]).join(units.select("unit", "family", "product_type", "broad", "launch_mi", "first_mi"), "unit")


def level(prefix: str = "") -> Column:
    return F.log(F.col(f"{prefix}pre") / F.col(f"{prefix}pre_months") + 0.5)


def change(prefix: str = "") -> Column:
    """The log change of the monthly mean."""
    return F.log(F.col(f"{prefix}post") / F.col(f"{prefix}post_months") + 0.5) - level(prefix)


class _Enough:
    """When a way has been read far enough: ten strict controls, ten of any kind beyond the strict volumes, or all of the relaxed ones."""

    @property
    def counts(self) -> dict[str, Column]:
        return {"n_strict": F.col("strict").cast("int"), "n_any": F.lit(1)}

    def __call__(self, edge: Column) -> Column:
        strict, relaxed = (round(math.log(ratio), 9) for _, ratio in (STRICT, RELAXED))
        return (F.col("n_strict") >= MOST_CONTROLS) | (F.round(edge, 9) > relaxed) | ((F.round(edge, 9) > strict) & (F.col("n_any") >= MOST_CONTROLS))


def candidates(events: DataFrame, pool: DataFrame, units: DataFrame, kinds: dict[str, str], block: int = BLOCK) -> DataFrame:
    """event_id, kind, control, gap, the control's windows and ``strict``: the units nearest by volume that fit as controls in the relaxed tier.

    ``kinds``: name by column that both must share. Both sides are laid out by
    kind, type of event, month and volume, and each event reads blocks outwards
    from its own place until it has ten controls each way or is beyond the
    ratio: so it meets some blocks, not all units of its type and month.
    """
    own = F.array(*(F.struct(F.lit(name).alias("kind"), F.col(column).alias("value")) for name, column in kinds.items()))
    named = lambda df: df.select("*", F.inline(own)).drop(*set(kinds.values()))
    e = named(settled(events.select("event_id", "event_type", "m0", *set(kinds.values()), "unit", "family", "launch_mi", "first_mi", "pre", "pre_months"), {"level": level()}))
    e = e.withColumn("request", F.concat("kind", F.lit("/"), "event_id")).drop("pre", "pre_months")
    c = pool.filter("pre > 0 and not spoiled").join(units.select("unit", "family", *set(kinds.values()), "launch_mi", "first_mi"), "unit")
    c = named(c.select("event_type", "m0", *set(kinds.values()), *(F.col(x).alias(f"c_{x}") for x in ("family", "launch_mi", "first_mi", "pre", "pre_months", "post", "post_months")), F.col("unit").alias("control")))
    c = settled(c, {"level": level("c_")})

    def meet(pairs: DataFrame) -> DataFrame:
        pairs = settled(pairs, {"gap": F.round(F.abs(F.col("there") - F.col("level")), 9), "apart": F.abs(F.col("c_launch_mi") - F.col("launch_mi"))})
        related = F.coalesce(F.col("family") == F.col("c_family"), F.lit(False))
        age = F.greatest(F.lit(12.0), 0.5 * (F.col("m0") - F.col("first_mi")))
        fits = [F.coalesce(F.col("apart") <= months, F.lit(True)) & (F.col("gap") <= round(math.log(ratio), 9)) for months, ratio in (STRICT, RELAXED)]
        kept = pairs.filter((F.col("unit") != F.col("control")) & ~related & (F.abs(F.col("c_first_mi") - F.col("first_mi")) <= age) & fits[1])
        return kept.select("request", "way", "event_id", "kind", "control", "gap", "c_pre", "c_pre_months", "c_post", "c_post_months", fits[0].alias("strict"))

    return nearest_first(e, c, ["kind", "value", "event_type", "m0"], "level", "control", meet, _Enough(), block).drop("request", "way")


def select_controls(events: DataFrame, pool: DataFrame, units: DataFrame, block: int = BLOCK) -> DataFrame:
    """event_id, control, tier, place and the control's windows in the event's months: the nearest by volume, ties to the lesser unit.

    Tiers: strict, relaxed where that finds fewer than three, then the broad type. ``events`` are those of ``placed``.
    """
    every = candidates(events, pool, units, {"near": "product_type", "broad": "broad"}, block)
    by_event = Window.partitionBy("event_id")
    near = F.col("kind") == "near"
    every = every.withColumns({"n_strict": F.sum((near & F.col("strict")).cast("int")).over(by_event), "n_near": F.sum(near.cast("int")).over(by_event)})
    tier = F.when(F.col("n_near") < LEAST_CONTROLS, "broad category").when(F.col("n_strict") < LEAST_CONTROLS, "relaxed").otherwise("strict")
    fits = F.when(F.col("tier") == "broad category", ~near).when(F.col("tier") == "relaxed", near).otherwise(near & F.col("strict"))
    place = F.row_number().over(by_event.orderBy("gap", "control"))
    return every.withColumn("tier", tier).filter(fits).drop("strict", "kind", "n_strict", "n_near").withColumn("place", place).filter(F.col("place") <= MOST_CONTROLS)


def log_variance(total: Column, months: Column) -> Column:
    """Variance of ln(X / months + 0.5) for a Poisson X of mean ``total``: what resampling the count tends to as repeats grow.

    Summed over X up to a mean of ``EXACT_MEAN``, by the fourth-order expansion beyond, where the two differ by less than 1e-4 of the value.
    """
    lam, c = total.cast("double"), months / 2.0
    m = lam + c
    steps = F.aggregate(
        F.sequence(F.lit(0), F.ceil(lam + 12 * F.sqrt(lam) + 20).cast("int")),
        F.struct(F.exp(-lam).alias("p"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
        lambda s, k: F.struct((s["p"] * lam / (k + 1)).alias("p"), (s["a"] + s["p"] * F.log((k + c) / m)).alias("a"), (s["b"] + s["p"] * F.pow(F.log((k + c) / m), F.lit(2.0))).alias("b")),
        lambda s: s["b"] - s["a"] * s["a"],
    )
    far = lam / m**2 - lam / m**3 + (2 * lam * lam + lam) / (4 * m**4) + 2 * (3 * lam * lam + lam) / (3 * m**4)
    return F.when(lam <= EXACT_MEAN, steps).otherwise(far)


def effects(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Events with n_controls, tier, tested and, where tested, log_effect and boot_var: change beyond the controls' mean change, and its resampling variance.

    The resampled parts are independent, so their variances add: both counts as Poisson, and the mean of controls drawn with replacement.
    """
    c = controls.withColumn("d", change("c_")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_controls"), F.max("tier").alias("tier"), F.avg("d").alias("d_c"), F.var_pop("d").alias("var_c"))
    rows = events.join(c, "event_id", "left").fillna(0, ["n_controls"]).fillna("broad category", ["tier"])
    tested = (F.col("pre") >= LEAST_REVIEWS) & (F.col("n_controls") >= LEAST_CONTROLS)
    var = log_variance(F.col("pre"), F.col("pre_months")) + log_variance(F.col("post"), F.col("post_months")) + F.col("var_c") / F.col("n_controls")
    rows = rows.withColumns({"tested": tested, "log_effect": F.when(tested, change() - F.col("d_c")), "boot_var": F.when(tested, var)})
    return rows.drop("d_c", "var_c")


def natural_swing(placebo: DataFrame) -> DataFrame:
    """event_window, n_null, swing, sizes: by window length the spread of changes at made dates, and their sorted sizes.

    A row a window; sizes are as many as placebo draws, whose number is a parameter and doesn't grow with the data.
    """
    q = placebo.filter("tested").groupBy("event_window").agg(
        F.percentile("log_effect", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.count(F.lit(1)).alias("n_null"), F.array_sort(F.collect_list(F.abs("log_effect"))).alias("sizes"))
    return q.select("event_window", "n_null", ((F.col("q")[1] - F.col("q")[0]) / (2 * Z95)).alias("swing"), "sizes")


def judged(rows: DataFrame, swing: DataFrame) -> DataFrame:
    """``rows`` with effect, lo, hi, verdict and p: the interval is widened by the swing, p is the share of made dates with as large a change."""
    rows = settled(rows.join(F.broadcast(swing), "event_window", "left").fillna(0.0, ["swing"]), {"sd": F.sqrt(F.col("boot_var") + F.col("swing") * F.col("swing"))})
    rows = rows.withColumns({"effect": F.exp("log_effect") - 1, "lo": F.exp(F.col("log_effect") - Z95 * F.col("sd")) - 1, "hi": F.exp(F.col("log_effect") + Z95 * F.col("sd")) - 1})
    moved = (F.abs("effect") >= MOVE) & ((F.col("lo") > 0) | (F.col("hi") < 0))
    size = F.abs("log_effect")
    # how many sizes are smaller, by halving: the sizes are sorted
    below = F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(F.col("n_null") + 1.0)).cast("int")),
        F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_null").alias("hi")),
        lambda s, _: _halved(s, size),
        lambda s: s["lo"],
    )
    p = F.when(F.col("tested") & F.col("n_null").isNotNull(), (F.col("n_null") - below + 1) / (F.col("n_null") + 1))
    verdict = F.when(~F.col("tested"), "not_enough_data").when(moved, "moved").otherwise("no_clear_change")
    return rows.withColumns({"p": p, "verdict": verdict, "near_zero_after": (F.col("post") / F.col("post_months") < 0.2 * F.col("pre") / F.col("pre_months")) & (F.col("post") < F.col("post_months"))}).drop("sizes")


def _halved(s: Column, size: Column) -> Column:
    mid = F.floor((s["lo"] + s["hi"]) / 2)
    open_ = s["lo"] < s["hi"]
    smaller = F.get(F.col("sizes"), mid.cast("int")) < size
    return F.struct(F.when(open_ & smaller, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~smaller, mid).otherwise(s["hi"]).alias("hi"))


def comparison_band(events: DataFrame, controls: DataFrame, counts: DataFrame, units: DataFrame, complete: int) -> DataFrame:
    """event_id, rel, own, lo, mid, hi: quartiles of the controls' months, scaled to the event's unit, and the unit's own count (null before its first month)."""
    window = F.create_map(*(F.lit(x) for pair in EVENT_WINDOWS.items() for x in pair))[F.col("event_type")]
    rel = events.withColumn("rel", F.explode(F.sequence(-window, window))).withColumn("mi", F.col("m0") + F.col("rel")).filter(F.col("mi") <= complete)
    scale = (F.col("pre") / F.col("pre_months") + 0.5) / (F.col("c_pre") / F.col("c_pre_months") + 0.5)
    n = counts.select("unit", "mi", "n")
    rows = rel.join(controls.select("event_id", "control", "c_pre", "c_pre_months"), "event_id").join(units.select(F.col("unit").alias("control"), F.col("first_mi").alias("c_first")), "control")
    rows = rows.filter("mi >= c_first").join(n.select(F.col("unit").alias("control"), "mi", F.col("n").alias("c_n")), ["control", "mi"], "left")
    band = rows.withColumn("v", F.coalesce("c_n", F.lit(0)) * scale).groupBy("event_id", "rel").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    own = rel.join(n, ["unit", "mi"], "left").select("event_id", "rel", F.when(F.col("mi") >= F.col("first_mi"), F.coalesce("n", F.lit(0))).alias("own"))
    return own.join(band, ["event_id", "rel"]).select("event_id", "rel", "own", *(F.col("q")[k].alias(c) for k, c in enumerate(("lo", "mid", "hi"))))


def low_rating_events(counts: DataFrame, complete: int) -> DataFrame:
    """unit, m0: months rated 0.3 or more under the twelve before, six months apart at least; ten reviews in the month and thirty before."""
    dense = dense_counts(counts, complete)
    year = Window.partitionBy("unit").orderBy("mi").rowsBetween(-12, -1)
    rows = dense.withColumns({"tn": F.sum("n").over(year), "ts": F.sum("stars").over(year)}).filter((F.col("mi") - F.col("first_mi") >= 12) & (F.col("mi") <= complete - 3))
    low = rows.filter("n >= 10 and tn >= 30").filter(F.col("stars") / F.col("n") <= F.col("ts") / F.col("tn") - 0.3)
    return cooled_down(low, ["unit"], "mi", 6).select("unit", F.explode("fired").alias("m0"))


def hashed(*parts: Column) -> Column:
    """A number in 0 to 1 from the md5 of the parts: the same in any engine and partitioning."""
    return F.conv(F.left(F.md5(F.concat_ws("/", *parts)), F.lit(12)), 16, 10).cast("long") / float(1 << 48)


def hashed_under(part: float, *parts: Column) -> Column:
    """Whether :func:`hashed` is less than ``part``: digits are compared as text, which is quicker where there are many rows."""
    least = math.ceil(part * (1 << 48))  # exact: a power of two times a double
    return F.md5(F.concat_ws("/", *parts)) < F.lit(f"{least:012x}")


def indexed_units(units: DataFrame) -> DataFrame:
    """Units with ix, their place by hash, from 0, and n_units; ranked in 256 parts and shifted, so that no task holds all."""
    rows = units.withColumn("part", F.left(F.md5("unit"), F.lit(2)))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    order = Window.orderBy("part")  # at most 256 rows
    sizes = sizes.select("part", (F.sum("k").over(order) - F.col("k")).alias("shift"), F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_units"))
    rows = rows.join(F.broadcast(sizes), "part")
    return rows.withColumn("ix", F.col("shift") + F.row_number().over(Window.partitionBy("part").orderBy("unit")) - 1).drop("part", "shift")


def placebo_events(units: DataFrame, marks: DataFrame, complete: int, draws: int, tag: str) -> DataFrame:
    """event_id, unit, event_type, m0 at made months of units with 60 reviews or more; sibling launches and low ratings in turn.

    Months within a window of a mark of any kind are left out. Drawn by hashes of ``tag`` and the draw.
    """
    able = indexed_units(units.filter("total >= 60").select("unit", "first_mi"))
    spark = units.sparkSession
    number = able.select("n_units").limit(1)
    k = spark.range(draws).withColumnRenamed("id", "k").join(F.broadcast(number)).withColumn("ix", F.floor(hashed(F.lit(tag), F.col("k"), F.lit("unit")) * F.col("n_units"))).drop("n_units")
    even = F.col("k") % 2 == 0
    rows = k.join(able, "ix").withColumn("event_type", F.when(even, "sibling_launch").otherwise("low_rating"))
    w = F.when(even, EVENT_WINDOWS["sibling_launch"]).otherwise(EVENT_WINDOWS["low_rating"])
    rows = settled(rows, {"lo": F.col("first_mi") + w, "hi": complete - w}).filter("lo <= hi")
    rows = rows.withColumn("m0", (F.col("lo") + F.floor(hashed(F.lit(tag), F.col("k"), F.lit("month")) * (F.col("hi") - F.col("lo") + 1))).cast("int"))
    near = spoiled_months(marks).select("unit", "m0").distinct()
    return rows.join(near, ["unit", "m0"], "left_anti").select(F.concat(F.lit(tag), "k").alias("event_id"), "unit", "event_type", "m0")
