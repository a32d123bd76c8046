"""Every named query against its oracle."""

import oracle
import pytest
from pyspark.sql import functions as F

from kelpline.plans import event_queries
from kelpline.plans.all import ORACLE, QUERIES
from kelpline.plans.event_queries import poisson


#: Case studies need longer histories than the smallest tables have.
FEW = {"tool_cases"}


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        assert oracle.differences(df, con, ORACLE[name]) == ""
    else:
        rows = df.collect()
        assert (rows or name in FEW) and len(df.columns) == len(set(df.columns)) and all(any(v is not None for v in r) for r in rows)


@pytest.mark.parametrize("name", ["placebo_draws", "bootstrap_ci", "pooled_effect"])
def test_draws_do_not_depend_on_partitions(spark, data, name):
    def got(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        event_queries._LAST_STUDY.clear()  # the study is made anew, not only what is asked of it
        return sorted([round(v, 9) if isinstance(v, float) else v for v in r] for r in QUERIES[name](spark, data).collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert got("1") == got("8") != []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_poisson_draws(spark):
    for rate in (0.0, 1.0, 7.0, 40.0):
        n, mean, var, least = spark.range(4000).select(poisson(F.lit(rate), "id").alias("k")).agg(F.count("*"), F.avg("k"), F.var_pop("k"), F.min("k")).first()
        assert n == 4000 and least >= 0 and abs(mean - rate) <= 0.08 * rate and abs(var - rate) <= 0.12 * rate
