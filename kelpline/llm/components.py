"""Connected components of a graph given as a table of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of ``links`` (a, b: long): comp is the least node that links lead to.

    Each round gives a node the least label among itself and its neighbours and
    then its label's own label, until nothing changes. Labels are written each
    round, so a lost executor costs a round; counts are pre-aggregated, so a
    node with a third of all links is no burden for one task.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        old = labels
        near = edges.join(old, F.col("a") == F.col("node")).groupBy("b").agg(F.min("comp").alias("near"))
        step = old.join(near, F.col("node") == F.col("b")).select("node", "comp", F.least("comp", "near").alias("next"))
        up = old.select(F.col("node").alias("next"), F.col("comp").alias("up"))
        labels = written(step.join(up, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("comp"), (F.least("next", F.coalesce("up", "next")) != F.col("comp")).alias("moved")), "labels")
        done = labels.filter("moved").limit(1).count() == 0
        labels = labels.select("node", "comp")
        drop_written(old)
        if done:
            return labels
