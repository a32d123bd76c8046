"""Exact quantiles of groups of any size: equal values count once, all are put in order once, and ranks are looked up there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import checkpointed


def cumulated(df: DataFrame, order: Sequence[str | Column], weight: Column, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``weight``, whole numbers, of all rows before in ``order``.

    Rows are sorted by ranges, so tasks are even whatever values are frequent;
    a task adds up its own rows and the sums of the tasks before. Rows of equal
    order come in any one order.
    """
    rows = checkpointed(df.withColumn("_w", weight.cast("long")).orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    task = F.shiftright("_row", 33)
    sizes = rows.groupBy(task.alias("_task")).agg(F.sum("_w").alias("_n"))
    by_task = Window.orderBy("_task")  # a row a task
    first = F.broadcast(sizes.select("_task", (F.sum("_n").over(by_task) - F.col("_n")).alias("_first")))
    inside = F.sum("_w").over(Window.partitionBy("_task").orderBy("_row")) - F.col("_w")
    return rows.withColumn("_task", task).withColumn("_inside", inside).join(first, "_task").withColumn(name, F.col("_first") + F.col("_inside")).drop("_w", "_row", "_task", "_inside", "_first")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], weight: Column | None = None) -> DataFrame:
    """keys, q: the quantiles ``qs`` of ``value`` in each group, between neighbours in proportion, as an array.

    The same numbers as ``percentile``, which holds all distinct values of a
    group in one task; here a group's values may be spread over all. Nulls
    don't count, groups without other values are left out, and NaN is the
    greatest value. A null key is a group. A row stands for ``weight`` values, one or more.
    """
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles are numbers from 0 to 1")
    keys = list(keys)
    kept = [F.col(k) for k in keys]
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_k"))
    cells = checkpointed(cumulated(cells, [*keys, "_v"], F.col("_k"), "_before"))
    same = F.lit(True)
    groups = cells.groupBy(*keys).agg(F.min("_before").alias("_from"), F.sum("_k").alias("_n")).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_from", "_n")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    at = F.transform(F.array(*map(F.lit, map(float, qs))), lambda q: q * (F.col("_n") - 1))
    asked = groups.select(*(f"_{i}" for i in range(len(keys))), "_from", F.posexplode(at).alias("_i", "_at"))
    rows = cells.join(asked, same) if keys else cells.join(F.broadcast(asked))  # without keys, a row a quantile
    first, last = F.col("_before") - F.col("_from"), F.col("_before") - F.col("_from") + F.col("_k") - 1
    low, high = F.floor("_at"), F.ceil("_at")
    met = rows.filter(((first <= low) & (low <= last)) | ((first <= high) & (high <= last)))
    pair = met.groupBy(*kept, "_i", "_at").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    part = F.col("_at") - F.floor("_at")
    found = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_a") + part * F.col("_b"))
    out = pair.withColumn("_q", F.struct("_i", found.alias("v"))).groupBy(*keys).agg(F.array_sort(F.collect_list("_q")).alias("q"))
    return out.filter(F.size("q") > 0).select(*keys, F.col("q.v").alias("q"))
