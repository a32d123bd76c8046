"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle, if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


#: The reviews fact in the oracle's SQL; queries' oracles go on from ``rv``.
RV = """
WITH rv0 AS (
  SELECT md5(concat_ws('-', l_orderkey, l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS review_id, l_partkey AS unit_id,
    CAST(l_shipdate AS DATE) AS review_date, CAST(floor((l_quantity - 1) / 10) AS INT) + 1 AS rating, l_linestatus = 'F' AS verified,
    CASE WHEN l_returnflag = 'R' THEN 'refurbished' ELSE 'new' END AS channel, CAST(o_orderdate AS DATE) AS order_date, l_shipdate < o_orderdate AS before_launch,
    p_name AS title, p_brand AS brand, p_type AS product_type, p_retailprice AS price, l_quantity AS months,
    CASE WHEN CAST(substr(p_brand, 7) AS INT) <= 12 THEN 'Own' ELSE 'Peers' END AS brand_set
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
la AS (SELECT unit_id, min(review_date) AS launch_date FROM rv0 GROUP BY 1),
rv1 AS (SELECT rv0.*, launch_date, greatest(0, (year(review_date) * 12 + month(review_date)) - (year(launch_date) * 12 + month(launch_date))) AS age_m,
    year(review_date) AS yr, CAST(rating <= 2 AS INT) AS low FROM rv0 JOIN la USING (unit_id)),
rv AS (SELECT *, CASE WHEN age_m < 6 THEN '0 to 6 months' WHEN age_m < 12 THEN '7 to 12 months' WHEN age_m < 24 THEN 'Year 2' WHEN age_m < 48 THEN 'Years 3 to 4' WHEN age_m < 999 THEN 'Year 5+' END AS age_band FROM rv1)
"""
