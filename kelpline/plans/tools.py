"""The nine read-only tools: validated, clamped arguments in, DataFrames of a few rows out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import first_rows, unpivoted
from ..sources.readers import reviews, units
from .registry import RV, query
from .review_queries import CASE_SQL, COMPLETE, DRIFT_SQL, cases, drift_of, failures

#: Caps, metrics, first and last month.
MOST_PRODUCTS, MOST_CASES, MOST_REVIEWS = 10, 12, 15
FIRST_MONTH, LAST_MONTH = "1990-01", "2001-11"
METRICS = {"most_reviewed": True, "highest_rated": True, "lowest_rated": False, "low_share": True, "rating_change": False, "early_failures": True}


class ToolError(ValueError):
    """An argument that a tool can't answer to."""


def clamp(value: int | None, low: int, high: int) -> int:
    return max(low, min(high, int(value if value is not None else high)))


def month(text: str | None, default: str) -> str:
    """YYYY-MM within the data; days are cut off."""
    if text is None:
        return default
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])(-\d{2})?", text):
        raise ToolError(f"not a month: {text!r}")
    return min(max(text[:7], FIRST_MONTH), LAST_MONTH)


def months(first: str | None, last: str | None) -> tuple[str, str]:
    a, b = month(first, FIRST_MONTH), month(last, LAST_MONTH)
    return (a, b) if a <= b else (b, a)


class Tools:
    """Tools over the bound tables of a directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        self.rv = reviews(spark, directory)
        self.units = units(spark, directory)

    def product_type(self, kind: str | None) -> str | None:
        """The stored type for a phrase, plurals allowed."""
        if kind is None:
            return None
        low = kind.strip().lower()
        forms = [low, low.removesuffix("s"), low.removesuffix("es")]
        # the table is asked for the few forms, its types aren't gathered
        found = self.units.filter(F.lower("product_type").isin(forms)).groupBy("product_type").agg(F.min(F.array_position(F.array(*map(F.lit, forms)), F.lower("product_type"))).alias("at")).orderBy("at", "product_type").first()
        if found is None:
            raise ToolError(f"unknown type: {kind!r}")
        return found["product_type"]

    def unit(self, unit_id: int) -> int:
        if self.units.filter(F.col("unit_id") == F.lit(unit_id)).limit(1).count() == 0:
            raise ToolError(f"unknown product: {unit_id!r}")
        return unit_id

    def find_products(self, text: str, kind: str | None = None, family: str | None = None, limit: int = MOST_PRODUCTS) -> DataFrame:
        words = F.lit(True)
        for w in text.split():
            words = words & F.col("title").ilike(f"%{w}%")
        keep = words | F.col("brand").ilike(f"%{text}%")
        if kind is not None:
            keep = keep & (F.col("product_type") == self.product_type(kind))
        if family is not None:
            keep = keep & (F.col("brand") == family)
        counts = self.rv.groupBy("unit_id").agg(F.count(F.lit(1)).alias("reviews"))
        found = self.units.filter(keep).join(counts, "unit_id", "left").select("unit_id", "title", "brand", "product_type", F.coalesce("reviews", F.lit(0)).alias("reviews"))
        return found.orderBy(F.col("reviews").desc(), "unit_id").limit(clamp(limit, 1, MOST_PRODUCTS))

    def get_product_timeline(self, unit_id: int, first: str | None = None, last: str | None = None, channel: str = "both") -> DataFrame:
        """Months, or quarters where the range has more than 48 months."""
        if channel not in ("new", "refurbished", "both"):
            raise ToolError(f"unknown channel: {channel!r}")
        a, b = months(first, last)
        rows = self.rv.filter(F.col("unit_id") == self.unit(unit_id)).withColumn("ym", F.date_format("review_date", "yyyy-MM")).filter(F.col("ym").between(a, b))
        rows = rows if channel == "both" else rows.filter(F.col("channel") == channel)
        long = (int(b[:4]) - int(a[:4])) * 12 + int(b[5:]) - int(a[5:]) + 1 > 48
        period = F.concat(F.year("review_date"), F.lit("-Q"), F.quarter("review_date")) if long else F.col("ym")
        return rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("rating"), 4).alias("avg_rating"), F.bool_and(F.col("review_date") < F.lit(COMPLETE)).alias("complete")).orderBy("period")

    def get_product_complaints(self, unit_id: int, least: int = 3) -> DataFrame:
        """Shares of complaint flags among low ratings, of the product and of its type."""
        kind = self.units.filter(F.col("unit_id") == self.unit(unit_id)).first()["product_type"]
        flags = {"early": F.col("months") < 4, "first_year": F.col("months") < 12, "carried_over": F.col("before_launch"), "verified": F.col("verified")}
        low = self.rv.filter("low = 1").filter(F.col("product_type") == kind)
        of = lambda df, name: unpivoted(df.agg(*(F.round(F.avg(c.cast("int")), 4).alias(k) for k, c in flags.items())).withColumn("i", F.lit(0)), ["i"], list(flags), "complaint", name).drop("i")
        own = low.filter(F.col("unit_id") == unit_id)
        if own.limit(least).count() < least:
            raise ToolError("too few low ratings")
        return of(own, "product_share").join(of(low, "type_share"), "complaint").orderBy(F.col("product_share").desc(), "complaint").limit(6)

    def compare_product_type(self, kind: str) -> DataFrame:
        rows = self.rv.filter(F.col("product_type") == self.product_type(kind))
        return rows.groupBy("brand_set").agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("low"), 6).alias("low_share"), F.median("months").alias("median_months"), F.round(F.avg("rating"), 6).alias("avg_rating"))

    def find_cases(self, kind: str | None = None, limit: int = MOST_CASES) -> DataFrame:
        found = cases(self.rv)
        found = found if kind is None else found.filter(F.col("product_type") == self.product_type(kind))
        return found.orderBy(F.col("excess").desc(), "product_type", "brand").limit(clamp(limit, 1, MOST_CASES))

    def rank_products(self, metric: str, kind: str | None = None, min_reviews: int = 10, limit: int = MOST_PRODUCTS) -> DataFrame:
        if metric not in METRICS:
            raise ToolError(f"unknown metric: {metric!r}")
        rv = self.rv if kind is None else self.rv.filter(F.col("product_type") == self.product_type(kind))
        if metric == "rating_change":
            rows = drift_of(rv, 3).select("unit_id", (F.col("n1") + F.col("n3")).alias("reviews"), F.col("change").alias("value"))
        else:
            value = {"most_reviewed": F.count(F.lit(1)).cast("double"), "highest_rated": F.avg("rating"), "lowest_rated": F.avg("rating"), "low_share": F.avg("low"), "early_failures": F.avg(F.when(F.col("low") == 1, (F.col("months") < 4).cast("int")))}[metric]
            rows = rv.groupBy("unit_id").agg(F.count(F.lit(1)).alias("reviews"), F.round(value, 6).alias("value"))
        rows = rows.filter(F.col("reviews") >= max(1, min_reviews)).filter("value is not null")
        order = F.col("value").desc() if METRICS[metric] else F.col("value").asc()
        return rows.orderBy(order, "unit_id").limit(clamp(limit, 1, MOST_PRODUCTS))

    def get_findings(self) -> DataFrame:
        """One row of headline numbers, all computed."""
        d = drift_of(self.rv, 3).agg(F.count(F.lit(1)).alias("units"), F.sum((F.col("change") < 0).cast("long")).alias("fell"))
        f = failures(self.spark, self.directory).agg(F.median("months").alias("median_months"), F.count(F.lit(1)).alias("failures"))
        r = self.rv.agg(F.round(F.avg("low"), 6).alias("low_share"), F.count(F.lit(1)).alias("reviews"))
        return d.join(F.broadcast(f)).join(F.broadcast(r))  # a row each

    def search_reviews(self, unit_id: int, first: str | None = None, last: str | None = None, channel: str | None = None, min_rating: int = 1, max_rating: int = 5, sort: str = "recent", limit: int = MOST_REVIEWS) -> DataFrame:
        a, b = months(first, last)
        lo, hi = sorted((clamp(min_rating, 1, 5), clamp(max_rating, 1, 5)))
        rows = self.rv.filter(F.col("unit_id") == self.unit(unit_id)).filter(F.date_format("review_date", "yyyy-MM").between(a, b) & F.col("rating").between(lo, hi))
        rows = rows if channel is None else rows.filter(F.col("channel") == channel)
        order = [F.col("review_date").desc()] if sort == "recent" else [F.col("verified").desc(), F.col("review_date").desc()]
        return rows.select("review_id", "review_date", "channel", "rating", "verified").orderBy(*order, "review_id").limit(clamp(limit, 1, MOST_REVIEWS))

    def set_view(self, unit_id: int, first: str | None = None, last: str | None = None, channels: list[str] | None = None, measure: str = "reviews") -> DataFrame:
        a, b = months(first, last)
        span = self.rv.filter(F.col("unit_id") == self.unit(unit_id)).agg(F.date_format(F.min("review_date"), "yyyy-MM").alias("a"), F.date_format(F.max("review_date"), "yyyy-MM").alias("b"))
        shown = [c for c in channels or ["new", "refurbished"] if c in ("new", "refurbished")] or ["new", "refurbished"]
        return span.select(F.lit(unit_id).alias("unit_id"), F.greatest(F.lit(a), "a").alias("first"), F.least(F.lit(b), "b").alias("last"), F.array_join(F.array(*map(F.lit, shown)), ",").alias("channels"), F.lit("volume" if measure == "reviews" else measure).alias("measure"))


@query("tool_find_products", RV + "SELECT p.p_partkey AS unit_id, p.p_name AS title, p.p_brand AS brand, p.p_type AS product_type, CAST(count(rv.unit_id) AS BIGINT) AS reviews FROM part p LEFT JOIN rv ON rv.unit_id = p.p_partkey WHERE (p.p_name ILIKE '%red%') OR p.p_brand ILIKE '%red%' GROUP BY 1, 2, 3, 4 ORDER BY reviews DESC, unit_id LIMIT 10")
def tool_find_products(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).find_products("red")


@query("tool_timeline_month_quarter", RV + "SELECT concat(year(review_date), '-Q', quarter(review_date)) AS period, CAST(count(*) AS BIGINT) AS reviews, round(avg(rating), 4) AS avg_rating, bool_and(review_date < DATE '2001-06-01') AS complete FROM rv WHERE unit_id = 1 GROUP BY 1")
def tool_timeline(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).get_product_timeline(1)


@query("tool_rank", RV + "SELECT unit_id, CAST(count(*) AS BIGINT) AS reviews, round(avg(low), 6) AS value FROM rv GROUP BY 1 HAVING count(*) >= 20 ORDER BY value DESC, unit_id LIMIT 10")
def tool_rank(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).rank_products("low_share", min_reviews=20)


@query("tool_search_reviews", RV + "SELECT review_id, review_date, channel, CAST(rating AS BIGINT) AS rating, verified FROM rv WHERE unit_id = 2 AND rating BETWEEN 1 AND 3 AND strftime(review_date, '%Y-%m') BETWEEN '1990-01' AND '2001-11' ORDER BY review_date DESC, review_id LIMIT 15")
def tool_search_reviews(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).search_reviews(2, min_rating=3, max_rating=1).withColumn("rating", F.col("rating").cast("long"))


@query("tool_compare_type", RV + "SELECT brand_set, CAST(count(*) AS BIGINT) AS reviews, round(avg(low), 6) AS low_share, median(months) AS median_months, round(avg(rating), 6) AS avg_rating FROM rv WHERE product_type = (SELECT min(p_type) FROM part) GROUP BY 1")
def tool_compare_type(spark: SparkSession, d: str) -> DataFrame:
    kind = units(spark, d).agg(F.min("product_type")).first()[0]
    return Tools(spark, d).compare_product_type(kind)


@query("tool_cases", CASE_SQL + "SELECT product_type, brand, CAST(yr AS INT) AS yr, jump, baseline, excess FROM (SELECT *, row_number() OVER (PARTITION BY product_type, brand ORDER BY excess DESC, yr) AS rn FROM c WHERE excess IS NOT NULL) WHERE rn = 1 ORDER BY excess DESC, product_type, brand LIMIT 12")
def tool_cases(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).find_cases()


@query("tool_findings", DRIFT_SQL + """SELECT (SELECT CAST(count(*) AS BIGINT) FROM dr) AS units, (SELECT CAST(count(*) FILTER (WHERE round(r3 - r1, 6) < 0) AS BIGINT) FROM dr) AS fell, (SELECT median(months) FROM rv WHERE low = 1 AND months <= 72) AS median_months,
  (SELECT CAST(count(*) AS BIGINT) FROM rv WHERE low = 1 AND months <= 72) AS failures, (SELECT round(avg(low), 6) FROM rv) AS low_share, (SELECT CAST(count(*) AS BIGINT) FROM rv) AS reviews""")
def tool_findings(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).get_findings()


@query("tool_complaints", RV + """, l AS (SELECT unit_id, CAST(months < 4 AS INT) AS early, CAST(months < 12 AS INT) AS first_year, CAST(before_launch AS INT) AS carried_over, CAST(verified AS INT) AS verified FROM rv WHERE low = 1 AND product_type = (SELECT p_type FROM part WHERE p_partkey = 1)),
u AS (SELECT unit_id, unnest([{'k': 'early', 'v': early}, {'k': 'first_year', 'v': first_year}, {'k': 'carried_over', 'v': carried_over}, {'k': 'verified', 'v': verified}]) AS x FROM l)
SELECT x.k AS complaint, round(avg(x.v) FILTER (WHERE unit_id = 1), 4) AS product_share, round(avg(x.v), 4) AS type_share FROM u GROUP BY 1""")
def tool_complaints(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).get_product_complaints(1)


@query("tool_set_view", RV + "SELECT CAST(1 AS INT) AS unit_id, greatest('1995-01', strftime(min(review_date), '%Y-%m')) AS first, least('2001-11', strftime(max(review_date), '%Y-%m')) AS last, 'new,refurbished' AS channels, 'volume' AS measure FROM rv WHERE unit_id = 1")
def tool_set_view(spark: SparkSession, d: str) -> DataFrame:
    return Tools(spark, d).set_view(1, "2003-01", "1995-01")


@query("most_recent_rise", RV + """, y AS (SELECT brand, yr, count(*) AS n, avg(low) AS l FROM rv GROUP BY 1, 2), j AS (SELECT *, lag(yr) OVER w AS pyr, lag(n) OVER w AS pn, lag(l) OVER w AS pl FROM y WINDOW w AS (PARTITION BY brand ORDER BY yr))
SELECT brand, CAST(max(yr) AS INT) AS yr, CAST(count(*) AS BIGINT) AS rises FROM j WHERE pyr = yr - 1 AND n >= 50 AND pn >= 50 AND round(l - pl, 6) >= 0.02 GROUP BY 1""")
def most_recent_rise(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("brand").orderBy("yr")
    y = reviews(spark, d).groupBy("brand", F.col("yr").cast("int").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.avg("low").alias("l"))
    j = y.withColumns({"pyr": F.lag("yr").over(w), "pn": F.lag("n").over(w), "pl": F.lag("l").over(w)}).filter("pyr = yr - 1 and n >= 50 and pn >= 50").filter(F.round(F.col("l") - F.col("pl"), 6) >= 0.02)
    return j.groupBy("brand").agg(F.max("yr").alias("yr"), F.count(F.lit(1)).alias("rises"))


@query("largest_in_family", RV + "SELECT brand, unit_id, CAST(n AS BIGINT) AS n FROM (SELECT brand, unit_id, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, unit_id) AS rn FROM rv GROUP BY 1, 2) WHERE rn = 1")
def largest_in_family(spark: SparkSession, d: str) -> DataFrame:
    counts = reviews(spark, d).groupBy("brand", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, ["brand"], [F.col("n").desc(), F.col("unit_id")])
