"""Joins along an order inside keys: the next value after each request, and the nearest values, block by block. No task holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cumulated
from .relational import checkpointed

#: Keys that are split at most, and parts that each is split into.
SPLIT_KEYS, PARTS = 1024, 32
#: Rows from which a key is split.
SPLIT_FROM = 20_000


def largest_keys(rows: DataFrame, keys: list[str], at_least: int = SPLIT_FROM, most: int = SPLIT_KEYS) -> DataFrame:
    """keys, size of the ``most`` largest keys with ``at_least`` rows: a table of bounded size, whatever the rows.

    A key that isn't among them has less than ``1 / most`` of all rows.
    """
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= at_least).orderBy(F.col("size").desc(), *keys).limit(most)


def next_after(requests: DataFrame, members: DataFrame, key: str, at: str, at_least: int = SPLIT_FROM) -> DataFrame:
    """``requests`` with ``next``: the least ``at`` of ``members`` (key, at) of the same key that is greater than their own; null without one.

    Both sides go through one window in descending order. Large keys are cut
    at quantiles of ``at``, a number; the least member of each part also stands
    behind all parts before it, up to the part with another member.
    """
    names = [c for c in requests.columns if c not in (key, at)]
    own = requests.select(key, at, F.struct(*names).alias("_own"), F.lit(True).alias("_asks"))
    there = members.select(key, at).select(key, at, F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), F.lit(False).alias("_asks"))
    rows = own.unionByName(there)
    large = largest_keys(rows.select(key), [key], at_least).collect()  # at most SPLIT_KEYS rows
    rows = _parted(rows, key, at, [r[key] for r in large]) if large else rows.withColumn("_part", F.lit(0))
    # of equal values requests come before members in this descending order, so that they don't see these
    down = Window.partitionBy(key, "_part").orderBy(F.col(at).desc(), F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("next", F.last(F.when(~F.col("_asks"), F.col(at)), ignorenulls=True).over(down))
    return rows.filter("_asks").select(key, at, *(F.col(f"_own.{n}").alias(n) for n in names), "next")


def _parted(rows: DataFrame, key: str, at: str, large: list) -> DataFrame:
    """``rows`` with ``_part``, cut for the keys ``large``, and the least member of each part in those before it."""
    cuts = F.percentile_approx(at, F.array(*(F.lit((i + 1) / PARTS) for i in range(PARTS - 1))), F.lit(1000))
    borders = F.broadcast(rows.filter(F.col(key).isin(large) & ~F.col("_asks")).groupBy(key).agg(F.array_distinct(cuts).alias("_cuts")))  # at most SPLIT_KEYS rows of PARTS numbers
    part = F.size(F.filter("_cuts", lambda c: c < F.col(at)))
    rows = rows.join(borders, key, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part))
    least = rows.filter("_cuts is not null and not _asks").groupBy(key, "_part").agg(F.min(at).alias(at))
    before = F.coalesce(F.lag("_part").over(Window.partitionBy(key).orderBy("_part")), F.lit(0))  # at most PARTS rows a key
    stands = least.withColumn("_from", before).filter("_part > 0").withColumn("_part", F.explode(F.sequence("_from", F.col("_part") - 1)))
    own = rows.schema["_own"].dataType
    return rows.drop("_cuts").unionByName(stands.select(key, at, F.lit(None).cast(own).alias("_own"), F.lit(False).alias("_asks"), "_part"))


def along(requests: DataFrame, members: DataFrame, keys: list[str], at: str, tie: str, block: int) -> tuple[DataFrame, DataFrame]:
    """``requests`` with ``start`` and ``members`` with ``place``, their positions in one order of all members by keys, ``at`` and ``tie``; members with ``block``, too.

    ``start`` is the place of the first member of the same keys that isn't
    before the request (``at``, and ``after``: whether equal ones are before
    it, too). All rows are sorted once by ranges, whatever keys and values are frequent.
    """
    names = {n: [c for c in df.columns if c not in (*keys, at)] for n, df in (("asks", requests), ("there", members))}
    empty = {n: F.lit(None).cast(df.select(F.struct(*names[n])).schema[0].dataType) for n, df in (("asks", requests), ("there", members))}
    asks = requests.select(*keys, at, F.when(F.col("after"), 2).otherwise(0).alias("_order"), F.lit(None).cast(members.schema[tie].dataType).alias("_tie"), F.struct(*names["asks"]).alias("asks"), empty["there"].alias("there"))
    there = members.select(*keys, at, F.lit(1).alias("_order"), F.col(tie).alias("_tie"), empty["asks"].alias("asks"), F.struct(*names["there"]).alias("there"))
    member = F.col("_order") == 1
    row = checkpointed(cumulated(asks.unionByName(there), [*keys, at, "_order", "_tie"], member.cast("long"), "place"))
    got = row.filter("_order != 1").select(*keys, at, *(F.col(f"asks.{n}").alias(n) for n in names["asks"]), F.col("place").alias("start"))
    had = row.filter("_order = 1").select(*keys, at, *(F.col(f"there.{n}").alias(n) for n in names["there"]), "place", F.floor(F.col("place") / block).alias("block"))
    return got, had


def nearest_first(requests: DataFrame, members: DataFrame, keys: list[str], at: str, tie: str, meet, enough, block: int = 64) -> DataFrame:
    """The pairs that ``meet`` makes of requests and members of the same keys, nearest first, until ``enough`` holds.

    ``requests`` have ``request`` (unique), keys and ``at``; members keys,
    ``at`` and ``tie``, and no other column names in common. Both are laid out
    twice, upwards and downwards, so that each direction goes through members
    by rising distance and, where that is equal, by ``tie``. ``meet(df)``
    filters and computes rows of both sides (member's value: ``there``), keeping
    ``request`` and ``way``. A round reads the next blocks of ``block`` members, twice
    as many as the one before; ``enough`` is a condition on ``edge``, the distance
    that has been read, and on the columns of ``meet`` that are aggregated by
    :func:`enough.counts`. A request costs blocks until it has enough, however
    many members its keys have.
    """
    ways = F.array(F.lit(1), F.lit(-1))
    axis = lambda df: df.withColumn("way", F.explode(ways)).withColumn(at, F.col(at) * F.col("way"))
    asks = axis(requests).withColumn("after", F.col("way") == -1)  # equal values belong to the upward way
    asks, there = along(asks, axis(members), ["way", *keys], at, tie, block)
    same = ["way", *keys]
    ends = there.groupBy("block").agg(F.max(F.struct("place", *same, at)).alias("_end")).select(F.col("block").alias("_last"), "_end")
    there = there.withColumnRenamed(at, "there")
    pending, found, done, width = asks.withColumn("_block", F.floor(F.col("start") / block)), None, 0, 2
    while True:
        reach = pending.withColumn("block", F.explode(F.sequence(F.col("_block") + done, F.col("_block") + (done + width - 1))))
        met = checkpointed(meet(reach.join(there, ["block", *same]).filter("place >= start")))
        found = met if found is None else found.unionByName(met)
        counts = met.groupBy("request", "way").agg(*(F.sum(c).alias(n) for n, c in enough.counts.items()))
        names = list(enough.counts)
        old = [F.coalesce(n, F.lit(0)) for n in names] if set(names) <= set(pending.columns) else [F.lit(0)] * len(names)
        pending = pending.select(*(c for c in pending.columns if c not in names), *(c.alias(f"_old_{n}") for n, c in zip(names, old, strict=True))).join(counts, ["request", "way"], "left")
        pending = pending.withColumns({n: F.coalesce(n, F.lit(0)) + F.col(f"_old_{n}") for n in names}).drop(*(f"_old_{n}" for n in names))
        pending = pending.withColumn("_last", F.col("_block") + (done + width - 1)).join(ends, "_last", "left")
        left = F.col("_end").isNotNull()
        for k in same:
            left = left & F.col(f"_end.{k}").eqNullSafe(F.col(k))
        edge = F.abs(F.col(f"_end.{at}") - F.col(at))
        pending = checkpointed(pending.withColumn("edge", edge).filter(left & ~enough(F.col("edge"))).drop("_last", "_end", "edge"))
        done, width = done + width, width * 2
        if not pending.limit(1).count():
            return found
