"""Operators composed of relational ones: dedup, panels, folds, profiles, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_series


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later expressions refer to and that the optimizer doesn't put into these again and again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """``df`` with the row number inside each key; give a total order, so that it is the same each time."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return ranked(df, keys, order, "_rn").filter(F.col("_rn") <= n).drop("_rn")


def rejected_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows but the first of each key."""
    return ranked(df, keys, order, "_rn").filter("_rn > 1").drop("_rn")


def month_runs(cells: DataFrame, keys: Sequence[str], month: str, last: Column, run: str = "_run") -> DataFrame:
    """``cells`` with ``run``: the months from each cell's own to the one before the key's next cell, or to ``last``; later cells are left out.

    Cells of one month are all kept, and the last of them has the run.
    """
    after = F.lead(month).over(Window.partitionBy(*keys).orderBy(month))
    rows = cells.filter(F.col(month) <= last).withColumn("_after", after)
    until = F.greatest(F.col(month), F.coalesce(F.add_months("_after", -1), last))
    return rows.withColumn(run, month_series(F.col(month), until)).drop("_after")


def dense_months(cells: DataFrame, keys: Sequence[str], month: str, last: Column, zero: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """``cells`` with a row for every month from each key's first to ``last``.

    Where there was none, the columns ``zero`` are 0, ``carried`` are those of
    the last month that had one, and others null. Only cells are sorted and
    dealt out by key; the months between them are listed where they stand.
    """
    rows = month_runs(cells, keys, month, last).withColumn("_at", F.explode("_run"))
    own = F.col("_at") == F.col(month)
    kinds = dict(cells.dtypes)
    of = lambda c: F.when(own, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast(kinds[c]) if c in zero else F.col(c) if c in carried else F.when(own, F.col(c))
    return rows.select(*keys, F.col("_at").alias(month), *(of(c).alias(c) for c in cells.columns if c not in (*keys, month)))


def running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Running sums: new column by summed column."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({new: F.sum(old).over(w) for new, old in sums.items()})


def cooled_down(df: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """Per key the array ``fired`` of those values of ``at`` that come ``gap`` or more after the last that fired."""
    sorted_at = F.array_sort(F.collect_list(F.col(at).cast("int")))
    fold = F.aggregate(sorted_at, F.array().cast("array<int>"), lambda acc, m: F.when((F.size(acc) == 0) | (m - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(m))).otherwise(acc))
    return df.groupBy(*keys).agg(fold.alias("fired"))


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def top_of_row(columns: Sequence[str]) -> Column:
    """Name of the column with the largest value, the first of equals."""
    return F.array_max(F.array(*(F.struct(F.col(c).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns))))["name"]


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: name, type, rows, filled, distinct values, least and greatest as text."""
    cols = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    kinds = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        text = F.col(f"`{c}`").cast("string")
        aggs += [F.count(text).alias(f"f{i}"), F.countDistinct(text).alias(f"d{i}"), F.min(text).alias(f"a{i}"), F.max(text).alias(f"z{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    row = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.col("n").alias("n_rows"), F.col(f"f{i}").alias("n_filled"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("least"), F.col(f"z{i}").alias("greatest")) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*row)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, of ``spark.checkpoint.dir``; one of its own only where that is unset and all runs on this machine."""
    path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp())
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder until the driver ends: for large tables, of which a checkpoint takes many times the space."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_ids(c: str) -> Column:
    """An aggregate: the ids of a group if they are three at most, else null; ids are whole numbers, each once. It holds three numbers, however large the group."""
    n, low, high = F.count(c), F.min(c), F.max(c)
    middle = F.bit_xor(c).bitwiseXOR(low).bitwiseXOR(high)
    return F.when(n == 1, F.array(low)).when(n == 2, F.array(low, high)).when(n == 3, F.array(low, middle, high))


def label_components(links: DataFrame) -> DataFrame:
    """node, comp of the graph with links (a, b): the least node that can be reached.

    Each round takes the least label of a node, its neighbours and its label's
    label, until none moves; every round is checkpointed, so plans stay short and
    executors may go.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = checkpointed(labels.join(near, "node").join(up, "comp", "left").select("node", "comp", F.least("near", "comp", F.coalesce("up", "comp")).alias("next")))
        moved = new.filter("next != comp").limit(1).count()
        labels = new.select("node", F.col("next").alias("comp"))
        if not moved:
            return labels


def confusion(df: DataFrame, predicted: Column, label: Column, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of boolean columns, in all or by key; a row counts ``weight`` times (a whole number)."""
    p, y = F.coalesce(predicted, F.lit(False)), F.coalesce(label, F.lit(False))
    counts = df.groupBy(*keys).agg(*(F.coalesce(F.sum(c.cast("long") if weight is None else F.when(c, weight).otherwise(0)), F.lit(0)).alias(n) for n, c in (("tp", p & y), ("fp", p & ~y), ("fn", ~p & y), ("tn", ~p & ~y))))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    rated = counts.withColumns({"precision": F.coalesce(precision, F.lit(0.0)), "recall": F.coalesce(recall, F.lit(0.0))})
    return rated.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def benjamini_hochberg(df: DataFrame, p: str, q: float) -> DataFrame:
    """``df`` with p_rank, p_count and survives: whether p is at most the largest p under its line.

    Ranks come from counts of equal and smaller p over a bounded number of
    buckets, so that no task holds all rows: a bucket is ranked by itself and
    shifted by the rows of the buckets before.
    """
    bucket = F.floor(F.least(F.col(p), F.lit(1.0)) * 1000).cast("int")
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "p_count": F.sum("_n").over(every)}).drop("_n")
    rows = rows.join(F.broadcast(sizes), "_b")  # at most 1001 rows
    rows = rows.withColumn("p_rank", F.col("_before") + F.count(F.lit(1)).over(Window.partitionBy("_b").orderBy(p).rangeBetween(Window.unboundedPreceding, 0)))
    line = rows.filter(F.col(p) <= F.col("p_rank") / F.col("p_count") * q).agg(F.max(p).alias("_line"))
    return rows.join(F.broadcast(line)).withColumn("survives", F.coalesce(F.col(p) <= F.col("_line"), F.lit(False))).drop("_b", "_before", "_line")
