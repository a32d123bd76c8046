"""The monthly panel kept up to date: a batch of reviews changes the parts of the table that hold its units, no others."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import new_folder, stored
from ..sources.readers import raw_reviews, reviews
from .registry import query
from .review_queries import PANEL_SQL, PANEL_SUMS, monthly, panel_of

CELLS = "unit_id long, channel string, month date, " + ", ".join(f"{c} long" for c in PANEL_SUMS) + ", part int, batch string"


def add_batch(reviews_of_batch: DataFrame, folder: str, batch: str, parts: int = 256) -> list[int]:
    """Add a batch of reviews to the tables ``cells`` and ``panel`` in ``folder``; returns the parts that were written.

    ``cells`` are counts and sums by unit, channel and month, a folder a part
    and batch: a batch that comes again replaces its own and nothing is
    counted twice. ``panel`` holds the dense months and running sums; a part is
    made anew from its cells of all batches, so rows may be as late as they
    like, and a unit's first month may move back. Units are dealt out by hash,
    so a part has about the same number of them.
    """
    spark = reviews_of_batch.sparkSession
    part = F.pmod(F.xxhash64("unit_id"), F.lit(parts)).cast("int")
    at, keys = f"{folder}/cells", ["part", "unit_id", "channel"]
    staged = stored(monthly(reviews_of_batch).withColumns({"part": part, "batch": F.lit(batch)}))
    touched = sorted(r[0] for r in staged.select("part").distinct().collect())  # at most ``parts`` rows
    if not touched:
        return []
    _into(_by_part(staged), at, len(touched), "part", "batch")
    cells = _by_part(spark.read.schema(CELLS).parquet(at).filter(F.col("part").isin(touched)))
    cells = cells.groupBy(*keys, "month").agg(*(F.sum(c).alias(c) for c in PANEL_SUMS))
    _into(panel_of(cells, keys), f"{folder}/panel", len(touched), "part")
    return touched


def _by_part(df: DataFrame) -> DataFrame:
    """Dealt out in order of part and unit: a task has one or a few parts, a part as many tasks as its rows need, and all of a unit is together."""
    return df.repartitionByRange(F.col("part"), F.col("unit_id"))


def _into(df: DataFrame, path: str, writers: int, *by: str) -> None:
    """Replace the folders of ``by`` that ``df`` has rows of; a task writes its few parts side by side, without sorting all rows by part first."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(writers))
    try:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    finally:
        conf.set(name, before)


@query("panel_upkeep", PANEL_SQL + "SELECT unit_id, channel, month, CAST(reviews AS BIGINT) AS reviews, CAST(low_ratings AS BIGINT) AS low_ratings, CAST(cum_reviews AS BIGINT) AS cum_reviews, round(cum_stars / cum_reviews, 6) AS cum_avg_rating FROM panel")
def panel_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """The panel after three batches: years up to 1996, later ones, and a tenth of both that came late."""
    rows = raw_reviews(spark, d).withColumn("late", F.crc32("review_id") % 10 == 0)
    wanted = ["unit_id", "channel", "review_date", "rating", "verified", "low", "before_launch", "yr", "late"]
    rv, folder = stored(reviews(spark, d, rows).select(*wanted)), new_folder(spark, "panel")
    late, early = F.col("late"), F.col("yr") <= 1996
    for name, rows in (("a", ~late & early), ("b", ~late & ~early), ("late", late)):
        add_batch(rv.filter(rows), folder, name, parts=16)
    columns = ["unit_id", "channel", "month", "reviews", "low_ratings", "cum_reviews", "cum_avg_rating"]
    return spark.read.parquet(f"{folder}/panel").select(*columns)
