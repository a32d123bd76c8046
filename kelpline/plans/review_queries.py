"""Named analyses of the reviews fact: panel, drift, life curve, trend, failure, refurbished, cases."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import AGE_BANDS, FAIL_BANDS
from ..functions.dates import band_place, banded, month_start, year_quarter
from ..operators.quantiles import exact_quantiles
from ..operators.relational import checkpointed, cooled_down, dense_months, few_ids, first_rows, month_runs, rejected_rows, running, stored, top_of_row, unpivoted
from ..sources.readers import read_table, reviews, units
from ..sources.sinks import documents
from .registry import RV, query

#: The last complete month, and the panel's last month.
COMPLETE, END = datetime.date(2001, 6, 1), datetime.date(2001, 11, 1)


def n_rows() -> Column:
    return F.count(F.lit(1))


def share(c: Column, digits: int = 6) -> Column:
    return F.round(F.avg(c.cast("double")), digits)


def mean(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.avg(c), digits)


def only(cond: Column, value: Column | str = "rating") -> Column:
    return F.when(cond, F.col(value) if isinstance(value, str) else value)


@query("scan_project_filter", "SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS ship_day, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= DATE '2000-01-01' AND l_discount BETWEEN 0.03 AND 0.05 AND l_returnflag <> 'A'")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    line = read_table(spark, d, "lineitem")
    keep = (F.col("l_shipdate") >= F.lit(datetime.datetime(2000, 1, 1)).cast("timestamp_ntz")) & F.col("l_discount").between(0.03, 0.05) & (F.col("l_returnflag") != "A")
    return line.filter(keep).select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("ship_day"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("predicate_mix", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 5 AND 30 AND (p_name ILIKE '%RED%' OR p_type LIKE 'S%') AND p_name ILIKE '%e%' AND p_name ILIKE '%a%' AND (p_retailprice > 1200) IS NOT TRUE")
def predicate_mix(spark: SparkSession, d: str) -> DataFrame:
    words = [F.col("p_name").ilike(f"%{w}%") for w in ("e", "a")]
    keep = ~F.col("p_brand").isin("Brand#1", "Brand#2") & F.col("p_size").between(5, 30) & (F.col("p_name").ilike("%RED%") | F.col("p_type").like("S%")) & words[0] & words[1]
    return read_table(spark, d, "part").filter(keep & ~F.coalesce(F.col("p_retailprice") > 1200, F.lit(False))).select("p_partkey", "p_name", "p_brand")


@query("dedup_rank", "SELECT doc_id, md5(text) AS text_md5, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")
    return first_rows(docs, ["text_md5"], [F.col("n_chars").desc(), F.col("doc_id")]).drop("n_chars")


@query("dedup_rejected", "SELECT doc_id, md5(text) AS text_md5, 'duplicate' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn > 1")
def dedup_rejected(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), "n_chars")
    return rejected_rows(docs, ["text_md5"], [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "text_md5", F.lit("duplicate").alias("reason"))


@query("left_join_before_launch", "SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS review_date, coalesce(l_shipdate < o_orderdate, false) AS before_launch FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def left_join_before_launch(spark: SparkSession, d: str) -> DataFrame:
    line, orders = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    rows = line.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("review_date"), F.coalesce(F.col("l_shipdate") < F.col("o_orderdate"), F.lit(False)).alias("before_launch"))


@query("semi_join_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def semi_join_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = read_table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return read_table(spark, d, "orders").join(scope, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("anti_join_orphans", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_orphans(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").join(read_table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("map_lookup_broadcast", "SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 'refurbished' WHEN 'A' THEN 'returned' ELSE l_returnflag END AS label, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def map_lookup_broadcast(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("R"), F.lit("refurbished"), F.lit("A"), F.lit("returned"))
    return read_table(spark, d, "lineitem").groupBy("l_returnflag").agg(n_rows().alias("n")).select("l_returnflag", F.coalesce(names[F.col("l_returnflag")], "l_returnflag").alias("label"), "n")


@query("unified_fact", RV + "SELECT review_id, unit_id, brand_set, product_type, channel, review_date, CAST(rating AS INT) AS rating, CAST(age_m AS INT) AS age_m, CAST(yr AS INT) AS yr, low, age_band, before_launch FROM rv")
def unified_fact(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).select("review_id", "unit_id", "brand_set", "product_type", "channel", "review_date", F.col("rating").cast("int"), F.col("age_m").cast("int"), F.col("yr").cast("int"), "low", "age_band", "before_launch")


@query("age_bands", RV + "SELECT age_band, CAST(count(*) AS BIGINT) AS n, round(avg(rating), 6) AS avg_rating FROM rv GROUP BY 1")
def age_bands(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("age_band").agg(n_rows().alias("n"), mean("rating").alias("avg_rating"))


def monthly(rv: DataFrame) -> DataFrame:
    """Cells of unit, channel and month with counts and integer sums."""
    month = month_start(F.col("review_date")).alias("month")
    return rv.groupBy("unit_id", "channel", month).agg(
        n_rows().alias("reviews"), F.sum(F.col("rating").cast("long")).alias("stars"), F.sum(F.col("verified").cast("long")).alias("verified"),
        F.sum(F.col("low").cast("long")).alias("low_ratings"), F.sum((F.col("rating") >= 4).cast("long")).alias("high_ratings"), F.sum(F.col("before_launch").cast("long")).alias("carried_over"),
    )


PANEL_SUMS = ["reviews", "stars", "verified", "low_ratings", "high_ratings", "carried_over"]


def panel(rv: DataFrame) -> DataFrame:
    return panel_of(monthly(rv))


def panel_of(cells: DataFrame, keys: Sequence[str] = ("unit_id", "channel")) -> DataFrame:
    """The dense monthly panel of cells (see ``monthly``) with running sums and the completeness flag; ``keys`` may have more columns that depend on the unit."""
    dense = dense_months(summed_cells(cells, keys), keys, "month", F.lit(END), PANEL_SUMS, ["cum_reviews", "cum_stars"])
    per = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return dense.withColumns({"avg_rating": per("stars", "reviews"), "cum_avg_rating": per("cum_stars", "cum_reviews"), "data_complete": F.col("month") <= F.lit(COMPLETE)})


def summed_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The panel's cells with running sums, which months without reviews don't change."""
    cells = cells.filter(F.col("month") <= F.lit(END)).fillna(0, PANEL_SUMS)
    return running(cells, keys, "month", {"cum_reviews": "reviews", "cum_stars": "stars"})


PANEL_SQL = RV + """, cells AS (SELECT unit_id, channel, CAST(date_trunc('month', review_date) AS DATE) AS month, count(*) AS reviews, sum(rating) AS stars, sum(CAST(verified AS INT)) AS verified,
    sum(low) AS low_ratings, sum(CAST(rating >= 4 AS INT)) AS high_ratings, sum(CAST(before_launch AS INT)) AS carried_over FROM rv GROUP BY 1, 2, 3),
grid AS (SELECT unit_id, channel, CAST(unnest(generate_series(m0, DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT unit_id, channel, min(month) AS m0 FROM cells GROUP BY 1, 2)),
dense AS (SELECT unit_id, channel, month, coalesce(reviews, 0) AS reviews, coalesce(stars, 0) AS stars, coalesce(verified, 0) AS verified, coalesce(low_ratings, 0) AS low_ratings,
    coalesce(high_ratings, 0) AS high_ratings, coalesce(carried_over, 0) AS carried_over FROM grid LEFT JOIN cells USING (unit_id, channel, month)),
panel AS (SELECT *, sum(reviews) OVER w AS cum_reviews, sum(stars) OVER w AS cum_stars FROM dense WINDOW w AS (PARTITION BY unit_id, channel ORDER BY month ROWS UNBOUNDED PRECEDING))
"""


@query("dense_month_panel", PANEL_SQL + "SELECT unit_id, channel, month, CAST(reviews AS BIGINT) AS reviews, CAST(stars AS BIGINT) AS stars, CAST(verified AS BIGINT) AS verified, CAST(low_ratings AS BIGINT) AS low_ratings, CAST(high_ratings AS BIGINT) AS high_ratings, CAST(carried_over AS BIGINT) AS carried_over, month <= DATE '2001-06-01' AS data_complete FROM panel")
def dense_month_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel(reviews(spark, d)).select("unit_id", "channel", "month", *PANEL_SUMS, "data_complete")


@query("panel_cumulative", PANEL_SQL + "SELECT unit_id, channel, month, CAST(cum_reviews AS BIGINT) AS cum_reviews, round(cum_stars / cum_reviews, 6) AS cum_avg_rating, round(stars / nullif(reviews, 0), 6) AS avg_rating FROM panel")
def panel_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return panel(reviews(spark, d)).select("unit_id", "channel", "month", "cum_reviews", "cum_avg_rating", "avg_rating")


@query("panel_gap_check", PANEL_SQL + "SELECT CAST(count(*) AS BIGINT) AS n_months, CAST(coalesce(sum(CASE WHEN prev IS NOT NULL AND month <> prev + INTERVAL 1 MONTH THEN 1 ELSE 0 END), 0) AS BIGINT) AS gaps, CAST(sum(CASE WHEN reviews = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_months FROM (SELECT *, lag(month) OVER (PARTITION BY unit_id, channel ORDER BY month) AS prev FROM panel)")
def panel_gap_check(spark: SparkSession, d: str) -> DataFrame:
    """The panel's months in order, run by run: inside each of the runs that the panel lists, and from one to the next."""
    keys = ["unit_id", "channel"]
    runs = month_runs(monthly(reviews(spark, d)), keys, "month", F.lit(END), "run")
    breaks = F.size(F.filter(F.sequence(F.lit(1), F.size("run")), lambda k: F.get("run", k) != F.add_months(F.get("run", k - 1), 1)))
    before = F.lag(F.element_at("run", -1)).over(Window.partitionBy(*keys).orderBy("month"))
    gap = F.coalesce(F.get("run", F.lit(0)) != F.add_months(before, 1), F.lit(False)).cast("int")
    zero = F.size("run") - (F.col("reviews") > 0).cast("int")
    counts = runs.select(F.size("run").alias("n"), (breaks + gap).alias("gaps"), zero.alias("zero"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_months"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"), F.sum("zero").alias("zero_months"))


@query("panel_reconcile", PANEL_SQL + "SELECT (SELECT CAST(sum(reviews) AS BIGINT) FROM panel) AS panel_reviews, (SELECT CAST(count(*) AS BIGINT) FROM rv WHERE review_date < DATE '2001-12-01') AS fact_reviews, (SELECT CAST(count(DISTINCT unit_id) AS BIGINT) FROM panel) AS units")
def panel_reconcile(spark: SparkSession, d: str) -> DataFrame:
    rv = reviews(spark, d)
    a = panel(rv).agg(F.sum("reviews").alias("panel_reviews"), F.countDistinct("unit_id").alias("units"))
    b = rv.filter(F.col("review_date") < F.lit(datetime.date(2001, 12, 1))).agg(n_rows().alias("fact_reviews"))
    return a.join(F.broadcast(b)).select("panel_reviews", "fact_reviews", "units")  # a row each


@query("product_summary_launch", RV + """, s AS (SELECT unit_id, min(order_date) AS listed, min(review_date) FILTER (WHERE channel = 'new') AS first_new, min(review_date) FILTER (WHERE channel = 'refurbished') AS first_refurbished,
    max(review_date) AS last_review, count(*) FILTER (WHERE channel = 'new') AS reviews_new, count(*) FILTER (WHERE channel = 'refurbished') AS reviews_refurbished, avg(rating) FILTER (WHERE channel = 'new') AS avg_new FROM rv GROUP BY 1)
SELECT unit_id, least(listed, first_new, first_refurbished) AS launch_date, CASE WHEN listed IS NULL THEN 'first review' WHEN listed <= least(first_new, first_refurbished) THEN 'listed date' ELSE 'first review (earlier than listed date)' END AS launch_source,
    first_new, first_refurbished, last_review, CAST(reviews_new AS BIGINT) AS reviews_new, CAST(reviews_refurbished AS BIGINT) AS reviews_refurbished, round(avg_new, 6) AS avg_rating_new FROM s""")
def product_summary_launch(spark: SparkSession, d: str) -> DataFrame:
    return summary(reviews(spark, d))


def summary(rv: DataFrame) -> DataFrame:
    new, old = F.col("channel") == "new", F.col("channel") == "refurbished"
    s = rv.groupBy("unit_id").agg(
        F.min("order_date").alias("listed"), F.min(only(new, "review_date")).alias("first_new"), F.min(only(old, "review_date")).alias("first_refurbished"), F.max("review_date").alias("last_review"),
        F.count(only(new)).alias("reviews_new"), F.count(only(old)).alias("reviews_refurbished"), mean(only(new)).alias("avg_rating_new"),
    )
    first = F.least("first_new", "first_refurbished")
    source = F.when(F.col("listed").isNull(), "first review").when(F.col("listed") <= first, "listed date").otherwise("first review (earlier than listed date)")
    return s.select("unit_id", F.least("listed", first).alias("launch_date"), source.alias("launch_source"), "first_new", "first_refurbished", "last_review", "reviews_new", "reviews_refurbished", "avg_rating_new")


@query("product_event_log", RV + """, s AS (SELECT unit_id, min(order_date) AS listed, min(review_date) FILTER (WHERE channel = 'new') AS a, min(review_date) FILTER (WHERE channel = 'refurbished') AS b, max(review_date) AS z FROM rv GROUP BY 1)
SELECT unit_id, 'launch' AS event_type, least(listed, a, b) AS event_date FROM s UNION ALL SELECT unit_id, 'first_review_new', a FROM s WHERE a IS NOT NULL UNION ALL SELECT unit_id, 'first_review_refurbished', b FROM s WHERE b IS NOT NULL
UNION ALL SELECT unit_id, 'listing_added', listed FROM s UNION ALL SELECT unit_id, 'last_review', z FROM s""")
def product_event_log(spark: SparkSession, d: str) -> DataFrame:
    new, old = F.col("channel") == "new", F.col("channel") == "refurbished"
    s = reviews(spark, d).groupBy("unit_id").agg(F.min("order_date").alias("listed"), F.min(only(new, "review_date")).alias("a"), F.min(only(old, "review_date")).alias("b"), F.max("review_date").alias("z"))
    kinds = [("launch", F.least("listed", "a", "b")), ("first_review_new", F.col("a")), ("first_review_refurbished", F.col("b")), ("listing_added", F.col("listed")), ("last_review", F.col("z"))]
    events = F.array(*(F.struct(F.lit(k).alias("event_type"), c.alias("event_date")) for k, c in kinds))
    return s.select("unit_id", F.inline(events)).filter("event_date is not null")


@query("comparable_types", RV + "SELECT product_type, CAST(count(*) FILTER (WHERE brand_set = 'Own') AS BIGINT) AS own, CAST(count(*) FILTER (WHERE brand_set = 'Peers') AS BIGINT) AS peers FROM rv WHERE channel = 'new' GROUP BY 1 HAVING own >= 2000 AND peers >= 2000")
def comparable_types(spark: SparkSession, d: str) -> DataFrame:
    own, peers = F.count(only(F.col("brand_set") == "Own")), F.count(only(F.col("brand_set") == "Peers"))
    return reviews(spark, d).filter("channel = 'new'").groupBy("product_type").agg(own.alias("own"), peers.alias("peers")).filter("own >= 2000 AND peers >= 2000")


def drift_of(rv: DataFrame, least: int) -> DataFrame:
    """Per unit the change of the mean rating from year 1 to years 3 to 4, where both have ``least`` reviews."""
    early, late = F.col("age_m") < 12, F.col("age_m").between(24, 47)
    rows = rv.filter("channel = 'new'").groupBy("brand_set", "product_type", "unit_id").agg(
        F.count(only(early)).alias("n1"), F.count(only(late)).alias("n3"), F.avg(only(early)).alias("r1"), F.avg(only(late)).alias("r3"), F.avg(only(early, "low")).alias("l1"), F.avg(only(late, "low")).alias("l3"))
    rows = rows.filter((F.col("n1") >= least) & (F.col("n3") >= least)).withColumn("change", F.round(F.col("r3") - F.col("r1"), 6))
    return rows.withColumns({c: F.round(c, 6) for c in ("r1", "r3", "l1", "l3")})


DRIFT_SQL = RV + """, dr AS (SELECT brand_set, product_type, unit_id, count(*) FILTER (WHERE age_m < 12) AS n1, count(*) FILTER (WHERE age_m BETWEEN 24 AND 47) AS n3, avg(rating) FILTER (WHERE age_m < 12) AS r1,
    avg(rating) FILTER (WHERE age_m BETWEEN 24 AND 47) AS r3, avg(low) FILTER (WHERE age_m < 12) AS l1, avg(low) FILTER (WHERE age_m BETWEEN 24 AND 47) AS l3 FROM rv WHERE channel = 'new' GROUP BY 1, 2, 3 HAVING n1 >= 3 AND n3 >= 3)
"""


@query("drift", DRIFT_SQL + "SELECT brand_set, product_type, unit_id, CAST(n1 AS BIGINT) AS n1, CAST(n3 AS BIGINT) AS n3, round(r1, 6) AS r1, round(r3, 6) AS r3, round(l1, 6) AS l1, round(l3, 6) AS l3, round(r3 - r1, 6) AS change FROM dr")
def drift(spark: SparkSession, d: str) -> DataFrame:
    return drift_of(reviews(spark, d), 3)


@query("drift_summary", DRIFT_SQL + "SELECT brand_set, CAST(count(*) AS BIGINT) AS units, CAST(count(*) FILTER (WHERE round(r3 - r1, 6) < 0) AS BIGINT) AS fell, round(avg(round(r3 - r1, 6)), 4) AS mean_change, round(median(round(r3 - r1, 6)), 4) AS median_change FROM dr GROUP BY 1")
def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    fell = F.sum((F.col("change") < 0).cast("long"))
    rows = checkpointed(drift_of(reviews(spark, d), 3))
    middle = exact_quantiles(rows, ["brand_set"], "change", [0.5]).select("brand_set", F.round(F.col("q")[0], 4).alias("median_change"))
    return rows.groupBy("brand_set").agg(n_rows().alias("units"), fell.alias("fell"), mean("change", 4).alias("mean_change")).join(middle, "brand_set", "left")


@query("life_curve", RV + """, u AS (SELECT brand_set, product_type, unit_id, age_band, avg(rating) AS r, avg(low) AS l FROM rv WHERE channel = 'new' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
SELECT brand_set, product_type, age_band, CAST(count(*) AS BIGINT) AS units, round(avg(r), 5) AS avg_rating, round(avg(l), 5) AS low_share FROM u GROUP BY 1, 2, 3
UNION ALL SELECT brand_set, 'All types', age_band, CAST(count(*) AS BIGINT), round(avg(r), 5), round(avg(l), 5) FROM u GROUP BY 1, 3""")
def life_curve(spark: SparkSession, d: str) -> DataFrame:
    u = reviews(spark, d).filter("channel = 'new'").groupBy("brand_set", "product_type", "unit_id", "age_band").agg(n_rows().alias("n"), F.avg("rating").alias("r"), F.avg("low").alias("l")).filter("n >= 5")
    every = u.withColumn("product_type", F.explode(F.array(F.col("product_type"), F.lit("All types"))))
    return every.groupBy("brand_set", "product_type", "age_band").agg(n_rows().alias("units"), mean("r", 5).alias("avg_rating"), mean("l", 5).alias("low_share"))


@query("calendar_trend", RV + "SELECT brand_set, product_type, CAST(yr AS INT) AS yr, CAST(count(*) AS BIGINT) AS n, round(avg(rating), 6) AS avg_rating, round(avg(low), 6) AS low_share FROM rv WHERE channel = 'new' GROUP BY 1, 2, 3 HAVING count(*) >= 100")
def calendar_trend(spark: SparkSession, d: str) -> DataFrame:
    return trend(reviews(spark, d))


def trend(rv: DataFrame) -> DataFrame:
    return rv.filter("channel = 'new'").groupBy("brand_set", "product_type", F.col("yr").cast("int").alias("yr")).agg(n_rows().alias("n"), mean("rating").alias("avg_rating"), mean("low").alias("low_share")).filter("n >= 100")


@query("trend_mix_neutral", RV + """, t AS (SELECT brand_set, product_type, yr, avg(rating) AS r, avg(low) AS l FROM rv WHERE channel = 'new' GROUP BY 1, 2, 3 HAVING count(*) >= 100),
full_types AS (SELECT product_type FROM (SELECT product_type, brand_set, count(DISTINCT yr) AS ny FROM t WHERE yr BETWEEN 1996 AND 2000 GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2 AND min(ny) = 5)
SELECT brand_set, CAST(yr AS INT) AS yr, CAST(count(*) AS BIGINT) AS types, round(avg(round(r, 6)), 5) AS avg_rating, round(avg(round(l, 6)), 5) AS low_share FROM t JOIN full_types USING (product_type) WHERE yr BETWEEN 1996 AND 2000 GROUP BY 1, 2""")
def trend_mix_neutral(spark: SparkSession, d: str) -> DataFrame:
    t = trend(reviews(spark, d)).filter("yr between 1996 and 2000")
    years = t.groupBy("product_type", "brand_set").agg(F.countDistinct("yr").alias("ny"))
    full = years.groupBy("product_type").agg(n_rows().alias("sets"), F.min("ny").alias("least")).filter("sets = 2 and least = 5")
    return t.join(full, "product_type", "left_semi").groupBy("brand_set", "yr").agg(n_rows().alias("types"), mean("avg_rating", 5).alias("avg_rating"), mean("low_share", 5).alias("low_share"))


FAIL_SQL = RV + """, f AS (SELECT brand_set, product_type, months, CASE WHEN months > 72 THEN NULL WHEN months < 1 THEN 'Under a month' WHEN months < 4 THEN '1 to 3 months' WHEN months < 12 THEN '4 to 11 months' WHEN months < 24 THEN 'About a year' WHEN months < 999 THEN '2 years or more' END AS fail_band FROM rv WHERE low = 1)
"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("months") <= 72, banded(F.col("months"), FAIL_BANDS))
    return reviews(spark, d).filter("low = 1").withColumn("fail_band", band).filter("fail_band is not null")


@query("failure_bands_grouping_sets", FAIL_SQL + "SELECT brand_set, CASE WHEN grouping(product_type) = 1 THEN 'All types' ELSE product_type END AS product_type, fail_band, CAST(count(*) AS BIGINT) AS n FROM f WHERE fail_band IS NOT NULL GROUP BY GROUPING SETS ((brand_set, product_type, fail_band), (brand_set, fail_band))")
def failure_bands_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    b, t, f = F.col("brand_set"), F.col("product_type"), F.col("fail_band")
    rows = failures(spark, d).groupingSets([[b, t, f], [b, f]], b, t, f).agg(n_rows().alias("n"), F.grouping("product_type").alias("g"))
    return rows.select("brand_set", F.when(F.col("g") == 1, "All types").otherwise(F.col("product_type")).alias("product_type"), "fail_band", "n")


@query("failure_summary_grouping_sets", FAIL_SQL + "SELECT brand_set, CASE WHEN grouping(product_type) = 1 THEN 'All types' ELSE product_type END AS product_type, CAST(count(*) AS BIGINT) AS n, median(months) AS median_months, round(avg(CAST(months < 12 AS INT)), 6) AS under_year, round(avg(CAST(months < 4 AS INT)), 6) AS under_four FROM f WHERE fail_band IS NOT NULL GROUP BY GROUPING SETS ((brand_set, product_type), (brand_set))")
def failure_summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    b, t = F.col("brand_set"), F.col("product_type")
    rows = failures(spark, d).groupingSets([[b, t], [b]], b, t).agg(n_rows().alias("n"), F.median("months").alias("median_months"), share(F.col("months") < 12).alias("under_year"), share(F.col("months") < 4).alias("under_four"), F.grouping("product_type").alias("g"))
    return rows.select("brand_set", F.when(F.col("g") == 1, "All types").otherwise(F.col("product_type")).alias("product_type"), "n", "median_months", "under_year", "under_four")


@query("refurb_cells", RV + "SELECT brand, CAST(yr AS INT) AS yr, CAST(count(*) FILTER (WHERE channel = 'new') AS BIGINT) AS n_new, CAST(count(*) FILTER (WHERE channel = 'refurbished') AS BIGINT) AS n_ref, round(avg(rating) FILTER (WHERE channel = 'refurbished') - avg(rating) FILTER (WHERE channel = 'new'), 6) AS gap FROM rv GROUP BY 1, 2 HAVING n_new >= 30 AND n_ref >= 30")
def refurb_cells(spark: SparkSession, d: str) -> DataFrame:
    new, old = F.col("channel") == "new", F.col("channel") == "refurbished"
    rows = reviews(spark, d).groupBy("brand", F.col("yr").cast("int").alias("yr")).agg(F.count(only(new)).alias("n_new"), F.count(only(old)).alias("n_ref"), F.round(F.avg(only(old)) - F.avg(only(new)), 6).alias("gap"))
    return rows.filter("n_new >= 30 and n_ref >= 30")


@query("refurb_theme_gap", RV + "SELECT product_type, round(avg(CAST(months < 4 AS INT)) FILTER (WHERE channel = 'refurbished') - avg(CAST(months < 4 AS INT)) FILTER (WHERE channel = 'new'), 6) AS early_gap, round(avg(CAST(before_launch AS INT)) FILTER (WHERE channel = 'refurbished') - avg(CAST(before_launch AS INT)) FILTER (WHERE channel = 'new'), 6) AS carried_gap FROM rv WHERE low = 1 GROUP BY 1")
def refurb_theme_gap(spark: SparkSession, d: str) -> DataFrame:
    new, old = F.col("channel") == "new", F.col("channel") == "refurbished"
    gap = lambda flag: F.round(F.avg(only(old, flag.cast("int"))) - F.avg(only(new, flag.cast("int"))), 6)
    return reviews(spark, d).filter("low = 1").groupBy("product_type").agg(gap(F.col("months") < 4).alias("early_gap"), gap(F.col("before_launch")).alias("carried_gap"))


CASE_SQL = RV + """, y AS (SELECT brand_set, product_type, brand, yr, count(*) AS n, avg(low) AS l FROM rv GROUP BY 1, 2, 3, 4),
j AS (SELECT *, lag(yr) OVER w AS pyr, lag(n) OVER w AS pn, lag(l) OVER w AS pl FROM y WINDOW w AS (PARTITION BY product_type, brand ORDER BY yr)),
base AS (SELECT product_type, yr, avg(l - pl) AS b FROM j WHERE brand_set = 'Peers' AND pyr = yr - 1 AND n >= 20 AND pn >= 20 GROUP BY 1, 2), every AS (SELECT yr, avg(l - pl) AS b FROM j WHERE brand_set = 'Peers' AND pyr = yr - 1 AND n >= 20 AND pn >= 20 GROUP BY 1),
c AS (SELECT j.product_type, j.brand, j.yr, round(j.l - j.pl, 6) AS jump, round(coalesce(base.b, every.b), 6) AS baseline, round(j.l - j.pl - coalesce(base.b, every.b), 6) AS excess FROM j LEFT JOIN base ON base.product_type = j.product_type AND base.yr = j.yr LEFT JOIN every ON every.yr = j.yr
  WHERE brand_set = 'Own' AND pyr = j.yr - 1 AND n >= 20 AND pn >= 20)
"""


@query("case_studies", CASE_SQL + "SELECT product_type, brand, CAST(yr AS INT) AS yr, jump, baseline, excess FROM (SELECT *, row_number() OVER (PARTITION BY product_type, brand ORDER BY excess DESC, yr) AS rn FROM c WHERE excess IS NOT NULL) WHERE rn = 1 ORDER BY excess DESC, product_type, brand LIMIT 12")
def case_studies(spark: SparkSession, d: str) -> DataFrame:
    return cases(reviews(spark, d)).orderBy(F.col("excess").desc(), "product_type", "brand").limit(12)


def cases(rv: DataFrame) -> DataFrame:
    """Per unit the largest year-on-year rise of the low share beyond the peers' mean rise, of the type or else of all types."""
    y = rv.groupBy("brand_set", "product_type", "brand", "yr").agg(n_rows().alias("n"), F.avg("low").alias("l"))
    w = Window.partitionBy("product_type", "brand").orderBy("yr")
    j = y.withColumns({"pyr": F.lag("yr").over(w), "pn": F.lag("n").over(w), "pl": F.lag("l").over(w)}).filter("pyr = yr - 1 and n >= 20 and pn >= 20").withColumn("rise", F.col("l") - F.col("pl"))
    peers = j.filter("brand_set = 'Peers'")
    base = peers.groupBy("product_type", "yr").agg(F.avg("rise").alias("b"))
    every = peers.groupBy("yr").agg(F.avg("rise").alias("b_all"))
    c = j.filter("brand_set = 'Own'").join(base, ["product_type", "yr"], "left").join(every, "yr", "left")
    b = F.coalesce("b", "b_all")
    c = c.select("product_type", "brand", F.col("yr").cast("int").alias("yr"), F.round("rise", 6).alias("jump"), F.round(b, 6).alias("baseline"), F.round(F.col("rise") - b, 6).alias("excess")).filter("excess is not null")
    return first_rows(c, ["product_type", "brand"], [F.col("excess").desc(), F.col("yr")])


@query("peer_eligibility", RV + "SELECT brand, CAST(count(*) AS BIGINT) AS n FROM rv WHERE brand_set = 'Peers' GROUP BY 1 HAVING count(*) >= 200")
def peer_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).filter("brand_set = 'Peers'").groupBy("brand").agg(n_rows().alias("n")).filter("n >= 200")


@query("family_rollup_mode", RV + """, k AS (SELECT brand, product_type, count(*) AS n FROM rv GROUP BY 1, 2), m AS (SELECT brand, product_type FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, product_type) AS rn FROM k) WHERE rn = 1)
SELECT brand, m.product_type AS main_type, CAST(count(*) AS BIGINT) AS reviews, CAST(count(DISTINCT unit_id) AS BIGINT) AS units, round(avg(low), 6) AS low_share FROM rv JOIN m USING (brand) GROUP BY 1, 2""")
def family_rollup_mode(spark: SparkSession, d: str) -> DataFrame:
    rv = reviews(spark, d)
    counts = rv.groupBy("brand", "product_type").agg(n_rows().alias("n"))
    main = first_rows(counts, ["brand"], [F.col("n").desc(), F.col("product_type")]).select("brand", F.col("product_type").alias("main_type"))
    total = rv.groupBy("brand").agg(n_rows().alias("reviews"), F.countDistinct("unit_id").alias("units"), mean("low").alias("low_share"))
    return total.join(main, "brand").select("brand", "main_type", "reviews", "units", "low_share")


@query("type_comparison_gaps", RV + """, s AS (SELECT product_type, brand_set, avg(low) AS low_share, avg(CAST(months < 4 AS INT)) AS early, avg(CAST(verified AS INT)) AS verified FROM rv GROUP BY 1, 2),
g AS (SELECT o.product_type, round(o.low_share - p.low_share, 6) AS low_share, round(o.early - p.early, 6) AS early, round(o.verified - p.verified, 6) AS verified FROM s o JOIN s p ON o.product_type = p.product_type AND o.brand_set = 'Own' AND p.brand_set = 'Peers'),
u AS (SELECT product_type, 'low_share' AS measure, low_share AS gap, 0 AS i FROM g UNION ALL SELECT product_type, 'early', early, 1 FROM g UNION ALL SELECT product_type, 'verified', verified, 2 FROM g)
SELECT product_type, measure, gap, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY abs(gap) DESC, measure) AS rn FROM u) WHERE rn <= 2""")
def type_comparison_gaps(spark: SparkSession, d: str) -> DataFrame:
    own, peers = F.col("brand_set") == "Own", F.col("brand_set") == "Peers"
    flags = {"low_share": F.col("low"), "early": (F.col("months") < 4).cast("int"), "verified": F.col("verified").cast("int")}
    g = reviews(spark, d).groupBy("product_type").agg(*(F.round(F.avg(only(own, c)) - F.avg(only(peers, c)), 6).alias(k) for k, c in flags.items()))
    u = unpivoted(g, ["product_type"], list(flags), "measure", "gap")
    w = Window.partitionBy("product_type").orderBy(F.abs("gap").desc(), "measure")
    return u.withColumn("place", F.row_number().over(w)).filter("place <= 2")


@query("top_theme_argmax", RV + """, g AS (SELECT brand, avg(low) AS low_share, avg(CAST(months < 4 AS INT)) AS early, avg(CAST(before_launch AS INT)) AS carried FROM rv GROUP BY 1)
SELECT brand, CASE WHEN low_share >= early AND low_share >= carried THEN 'low_share' WHEN early >= carried THEN 'early' ELSE 'carried' END AS top FROM g""")
def top_theme_argmax(spark: SparkSession, d: str) -> DataFrame:
    g = reviews(spark, d).groupBy("brand").agg(F.avg("low").alias("low_share"), F.avg((F.col("months") < 4).cast("int")).alias("early"), F.avg(F.col("before_launch").cast("int")).alias("carried"))
    return g.select("brand", top_of_row(["low_share", "early", "carried"]).alias("top"))


@query("product_index", DRIFT_SQL + """, ix AS (SELECT unit_id, any_value(title) AS title, any_value(brand) AS brand, any_value(product_type) AS product_type, min(least(order_date, review_date)) AS launch, count(*) FILTER (WHERE channel = 'new') AS reviews_new, count(*) FILTER (WHERE channel <> 'new') AS reviews_refurbished,
    avg(rating) FILTER (WHERE channel = 'new') AS rating_new, avg(low) FILTER (WHERE channel = 'new') AS low_share, count(*) FILTER (WHERE channel = 'new' AND low = 1) AS low_reviews,
    avg(CAST(months < 4 AS INT)) FILTER (WHERE channel = 'new' AND low = 1) AS early, avg(CAST(before_launch AS INT)) FILTER (WHERE channel = 'new' AND low = 1) AS carried, avg(CAST(NOT verified AS INT)) FILTER (WHERE channel = 'new' AND low = 1) AS unverified FROM rv GROUP BY 1)
SELECT ix.unit_id, title, ix.brand, ix.product_type, launch, CAST(reviews_new AS BIGINT) AS reviews_new, CAST(reviews_refurbished AS BIGINT) AS reviews_refurbished, round(rating_new, 6) AS rating_new, round(low_share, 6) AS low_share, CAST(low_reviews AS BIGINT) AS low_reviews,
    CASE WHEN low_reviews < 5 OR greatest(early, carried, unverified) = 0 THEN NULL WHEN early >= carried AND early >= unverified THEN 'early' WHEN carried >= unverified THEN 'carried' ELSE 'unverified' END AS top_theme, round(dr.r3 - dr.r1, 6) AS drift FROM ix LEFT JOIN dr USING (unit_id)""")
def product_index(spark: SparkSession, d: str) -> DataFrame:
    rv = reviews(spark, d)
    return index_rows(rv, {"early": F.col("months") < 4, "carried": F.col("before_launch"), "unverified": ~F.col("verified")}, 5, drift_of(rv, 3))


def index_rows(rv: DataFrame, themes: dict[str, Column], least: int, changes: DataFrame) -> DataFrame:
    """A row a unit for an index: reviews, low share, the theme that leads its low ratings (from ``least`` of them on, the first of equals) and its drift."""
    new = F.col("channel") == "new"
    low = new & (F.col("low") == 1)
    rows = rv.groupBy("unit_id").agg(
        F.first("title").alias("title"), F.first("brand").alias("brand"), F.first("product_type").alias("product_type"), F.min(F.least("order_date", "review_date")).alias("launch"), F.count(only(new)).alias("reviews_new"),
        F.count(only(~new)).alias("reviews_refurbished"), mean(only(new)).alias("rating_new"), mean(only(new, "low")).alias("low_share"), F.count(only(low)).alias("low_reviews"), *(F.avg(F.when(low, c.cast("int"))).alias(k) for k, c in themes.items()))
    top = F.when((F.col("low_reviews") >= least) & (F.greatest(*themes) > 0), top_of_row(list(themes)))
    return rows.withColumn("top_theme", top).drop(*themes).join(changes.select("unit_id", F.col("change").alias("drift")), "unit_id", "left")


@query("channel_pivot", RV + "SELECT product_type, CAST(count(*) FILTER (WHERE channel = 'new') AS BIGINT) AS new_reviews, CAST(count(*) FILTER (WHERE channel = 'refurbished') AS BIGINT) AS refurbished_reviews FROM rv GROUP BY 1")
def channel_pivot(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("product_type").pivot("channel", ["new", "refurbished"]).agg(n_rows()).select("product_type", F.col("new").alias("new_reviews"), F.col("refurbished").alias("refurbished_reviews"))


@query("band_share_of_total", FAIL_SQL + "SELECT brand_set, fail_band, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY brand_set), 6) AS part_of_set FROM (SELECT brand_set, fail_band, count(*) AS n FROM f WHERE fail_band IS NOT NULL GROUP BY 1, 2)")
def band_share_of_total(spark: SparkSession, d: str) -> DataFrame:
    rows = failures(spark, d).groupBy("brand_set", "fail_band").agg(n_rows().alias("n"))
    return rows.withColumn("part_of_set", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("brand_set")), 6))


@query("peak_month", PANEL_SQL + "SELECT unit_id, month, CAST(reviews AS BIGINT) AS reviews FROM (SELECT unit_id, month, sum(reviews) AS reviews, row_number() OVER (PARTITION BY unit_id ORDER BY sum(reviews) DESC, month) AS rn FROM panel GROUP BY 1, 2) WHERE rn = 1")
def peak_month(spark: SparkSession, d: str) -> DataFrame:
    """The panel's empty months are left out: a unit in the panel has a month with reviews, and that is larger."""
    month = month_start(F.col("review_date")).alias("month")
    by_month = reviews(spark, d).groupBy("unit_id", month).agg(n_rows().alias("reviews")).filter(F.col("month") <= F.lit(END))
    return first_rows(by_month, ["unit_id"], [F.col("reviews").desc(), F.col("month")])


@query("group_picker_order", RV + "SELECT brand AS grp, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT unit_id) AS BIGINT) AS units, count(DISTINCT unit_id) < 5 AS few_products FROM rv GROUP BY 1")
def group_picker_order(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy(F.col("brand").alias("grp")).agg(n_rows().alias("total"), F.countDistinct("unit_id").alias("units")).withColumn("few_products", F.col("units") < 5).orderBy(F.col("total").desc(), "grp")


@query("low_rating_months", RV + """, m AS (SELECT brand, (year(review_date) * 12 + month(review_date) - 1) AS mi, count(*) AS n, sum(rating) AS s FROM rv GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER w AS tn, sum(s) OVER w AS ts, row_number() OVER (PARTITION BY brand ORDER BY mi) AS rn FROM m WINDOW w AS (PARTITION BY brand ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT brand, CAST(mi AS INT) AS mi, round(s / n, 6) AS avg_rating, round(ts / tn, 6) AS trailing_avg FROM t WHERE rn > 12 AND n >= 10 AND tn >= 30 AND s / n <= ts / tn - 0.3""")
def low_rating_months(spark: SparkSession, d: str) -> DataFrame:
    return low_months(reviews(spark, d))


def low_months(rv: DataFrame) -> DataFrame:
    """Months whose mean rating is 0.3 or more under that of the twelve before."""
    index = (F.year("review_date") * 12 + F.month("review_date") - 1).alias("mi")
    m = rv.groupBy("brand", index).agg(n_rows().alias("n"), F.sum(F.col("rating").cast("long")).alias("s"))
    order = Window.partitionBy("brand").orderBy("mi")
    t = m.withColumns({"tn": F.sum("n").over(order.rowsBetween(-12, -1)), "ts": F.sum("s").over(order.rowsBetween(-12, -1)), "rn": F.row_number().over(order)})
    t = t.filter("rn > 12 and n >= 10 and tn >= 30").filter(F.col("s") / F.col("n") <= F.col("ts") / F.col("tn") - 0.3)
    return t.select("brand", F.col("mi").cast("int").alias("mi"), F.round(F.col("s") / F.col("n"), 6).alias("avg_rating"), F.round(F.col("ts") / F.col("tn"), 6).alias("trailing_avg"))


@query("cooldown_events", RV.replace("WITH", "WITH RECURSIVE", 1) + """, m AS (SELECT brand, year(review_date) * 12 + month(review_date) - 1 AS mi, count(*) AS n, sum(rating) AS s FROM rv GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER y AS tn, sum(s) OVER y AS ts, row_number() OVER (PARTITION BY brand ORDER BY mi) AS rn FROM m WINDOW y AS (PARTITION BY brand ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
lo AS (SELECT brand, mi FROM t WHERE rn > 12 AND n >= 10 AND tn >= 30 AND s / n <= ts / tn - 0.3),
fired AS (SELECT brand, min(mi) AS mi FROM lo GROUP BY 1 UNION ALL SELECT f.brand, min(lo.mi) FROM fired f JOIN lo ON lo.brand = f.brand AND lo.mi >= f.mi + 6 GROUP BY f.brand, f.mi) SELECT brand, CAST(mi AS INT) AS mi FROM fired""")
def cooldown_events(spark: SparkSession, d: str) -> DataFrame:
    fired = cooled_down(low_months(reviews(spark, d)), ["brand"], "mi", 6)
    return fired.select("brand", F.explode("fired").alias("mi"))


@query("sibling_events", RV + """, l AS (SELECT unit_id, brand, product_type, min(year(review_date) * 12 + month(review_date) - 1) AS mi FROM rv GROUP BY 1, 2, 3)
SELECT a.unit_id, CAST(b.mi AS INT) AS mi, CAST(count(*) AS BIGINT) AS siblings, CASE WHEN count(*) >= 4 THEN concat(count(*), ' siblings launched') ELSE string_agg(CAST(b.unit_id AS VARCHAR), ', ' ORDER BY b.unit_id) END AS detail
FROM l a JOIN l b ON a.brand = b.brand AND a.product_type = b.product_type AND a.unit_id <> b.unit_id AND b.mi >= a.mi + 2 GROUP BY 1, 2""")
def sibling_events(spark: SparkSession, d: str) -> DataFrame:
    """A unit's row comes from the months of its brand and type, so units never meet each other.

    Without their months, units of the same brand and type have the same siblings: all that launch two months later or more.
    """
    index = F.year("review_date") * 12 + F.month("review_date") - 1
    launches = stored(reviews(spark, d).groupBy("unit_id", "brand", "product_type").agg(F.min(index).cast("int").alias("mi")))
    months = checkpointed(launches.groupBy("brand", "product_type", "mi").agg(n_rows().alias("siblings"), few_ids("unit_id").alias("ids")))
    later = months.select("brand", "product_type", F.struct(F.col("mi").alias("at"), "siblings", "ids").alias("later"))
    later = months.select("brand", "product_type", "mi").join(later, ["brand", "product_type"]).filter("later.at >= mi + 2")
    later = later.groupBy("brand", "product_type", "mi").agg(F.collect_list("later").alias("later"))  # at most a row a month
    rows = launches.withColumn("sets", n_rows().over(Window.partitionBy("unit_id"))).join(later, ["brand", "product_type", "mi"]).select("unit_id", "sets", F.inline("later"))
    rows = rows.withColumnRenamed("at", "mi")
    # a unit of several brands or types, which only a catalogue with repeated keys has, gets the siblings of all of them
    several = rows.filter("sets > 1").groupBy("unit_id", "mi").agg(F.sum("siblings").alias("siblings"), F.flatten(F.collect_list("ids")).alias("ids"))
    names = F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ", ")
    merged = rows.filter("sets = 1").select("unit_id", "mi", "siblings", "ids").unionByName(several)
    return merged.select("unit_id", "mi", "siblings", F.when(F.col("siblings") >= 4, F.concat(F.col("siblings"), F.lit(" siblings launched"))).otherwise(names).alias("detail"))


@query("product_document_json", RV + """, y AS (SELECT unit_id, string_agg(concat('{"yr":', yr, ',"reviews":', n, ',"avg_rating":', r, ',"low_share":', l, '}'), ',' ORDER BY yr) AS years FROM (SELECT unit_id, yr, count(*) AS n, round(avg(rating), 4) AS r, round(avg(low), 4) AS l FROM rv GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT unit_id, string_agg(concat('{"age_band":"', age_band, '","reviews":', n, ',"avg_rating":', r, '}'), ',' ORDER BY age_band) AS bands FROM (SELECT unit_id, age_band, count(*) AS n, round(avg(rating), 4) AS r FROM rv GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT unit_id, any_value(title) AS title, any_value(brand) AS brand, any_value(product_type) AS product_type, any_value(price) AS price, any_value(brand_set) AS brand_set, min(order_date) AS listed, min(review_date) FILTER (WHERE channel = 'new') AS a, min(review_date) FILTER (WHERE channel = 'refurbished') AS z,
  max(review_date) AS last_review, count(*) FILTER (WHERE channel = 'new') AS n_new, count(*) FILTER (WHERE channel = 'refurbished') AS n_ref, round(round(avg(rating) FILTER (WHERE channel = 'new'), 6), 4) AS r FROM rv GROUP BY 1)
SELECT concat('{"unit_id":', unit_id, ',"title":"', title, '","brand":"', brand, '","product_type":"', product_type, '","price":', round(price, 4), ',"brand_set":"', brand_set, '","launch_date":"', least(listed, a, z), '","launch_source":"', CASE WHEN listed <= least(a, z) THEN 'listed date' ELSE 'first review (earlier than listed date)' END,
  '","first_new":', coalesce('"' || a || '"', 'null'), ',"first_refurbished":', coalesce('"' || z || '"', 'null'), ',"last_review":"', last_review, '","reviews_new":', n_new, ',"reviews_refurbished":', n_ref, ',"avg_rating_new":', coalesce(CAST(r AS VARCHAR), 'null'), ',"years":[', years, '],"lifecycle":[', bands, ']}') AS json FROM s JOIN y USING (unit_id) JOIN b USING (unit_id)""")
def product_document_json(spark: SparkSession, d: str) -> DataFrame:
    rv = reviews(spark, d)
    years = rv.groupBy("unit_id", "yr").agg(n_rows().alias("reviews"), F.avg("rating").alias("avg_rating"), F.avg("low").alias("low_share"))
    years = years.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("yr", "reviews", "avg_rating", "low_share"))).alias("years"))
    bands = rv.groupBy("unit_id", "age_band").agg(n_rows().alias("reviews"), F.avg("rating").alias("avg_rating"))
    bands = bands.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("age_band", "reviews", "avg_rating"))).alias("lifecycle"))
    doc = units(spark, d).join(summary(rv), "unit_id").join(years, "unit_id").join(bands, "unit_id")
    return documents(doc)


@query("portfolio_json", RV + """, t AS (SELECT brand_set, product_type, count(*) AS n, round(avg(low), 4) AS l FROM rv GROUP BY 1, 2)
SELECT concat('{"brand_set":"', brand_set, '","types":[', string_agg(concat('{"product_type":"', product_type, '","reviews":', n, ',"low_share":', l, '}'), ',' ORDER BY product_type), ']}') AS json FROM t GROUP BY brand_set""")
def portfolio_json(spark: SparkSession, d: str) -> DataFrame:
    rv = reviews(spark, d)
    types = rv.groupBy("brand_set", "product_type").agg(n_rows().alias("reviews"), F.avg("low").alias("low_share"))
    return documents(types.groupBy("brand_set").agg(F.array_sort(F.collect_list(F.struct("product_type", "reviews", "low_share"))).alias("types")))


@query("timeline_quarters", RV + "SELECT brand, concat(year(review_date), '-Q', quarter(review_date)) AS period, CAST(count(*) AS BIGINT) AS reviews, round(sum(rating) / count(*), 6) AS avg_rating FROM rv GROUP BY 1, 2")
def timeline_quarters(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("brand", year_quarter(F.col("review_date")).alias("period")).agg(n_rows().alias("reviews"), mean("rating").alias("avg_rating"))


_PLACES = "CASE age_band " + " ".join(f"WHEN '{name}' THEN {k}" for k, (_, name) in enumerate(AGE_BANDS, 1)) + " END"


@query("lifecycle_bands", RV + f""", b AS (SELECT product_type, brand, age_band, CAST({_PLACES} AS INT) AS place, count(*) AS n, avg(rating) AS r FROM rv WHERE channel = 'new' GROUP BY 1, 2, 3 HAVING count(*) >= 30)
SELECT product_type, brand, age_band, place, CAST(n AS BIGINT) AS reviews, round(r, 5) AS avg_rating, round(r - lag(r) OVER (PARTITION BY product_type, brand ORDER BY place), 5) AS change FROM b""")
def lifecycle_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of at least 30 reviews in the bands' own order, and the change from the shown band before."""
    b = reviews(spark, d).filter("channel = 'new'").groupBy("product_type", "brand", "age_band").agg(n_rows().alias("reviews"), F.avg("rating").alias("r")).filter("reviews >= 30")
    b = b.withColumn("place", band_place(F.col("age_band"), AGE_BANDS))
    before = F.lag("r").over(Window.partitionBy("product_type", "brand").orderBy("place"))
    return b.select("product_type", "brand", "age_band", "place", "reviews", F.round("r", 5).alias("avg_rating"), F.round(F.col("r") - before, 5).alias("change"))


@query("key_set_operations", RV + """, n AS (SELECT DISTINCT unit_id, yr FROM rv WHERE channel = 'new' AND low = 1), o AS (SELECT DISTINCT unit_id, yr FROM rv WHERE channel = 'refurbished' AND low = 1),
s AS (SELECT 'both' AS part, * FROM (SELECT * FROM n INTERSECT SELECT * FROM o) UNION ALL SELECT 'new only', * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'refurbished only', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'any', * FROM (SELECT * FROM n UNION SELECT * FROM o))
SELECT part, CAST(yr AS INT) AS yr, CAST(count(*) AS BIGINT) AS units, CAST(sum(unit_id) AS BIGINT) AS id_sum FROM s GROUP BY 1, 2""")
def key_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Units and years with low ratings of new and of refurbished units: sets of keys met, taken away and joined."""
    keys = reviews(spark, d).filter("low = 1")
    new, old = (keys.filter(F.col("channel") == c).select("unit_id", F.col("yr").cast("int").alias("yr")) for c in ("new", "refurbished"))
    sets = {"both": new.intersect(old), "new only": new.subtract(old), "refurbished only": old.subtract(new), "any": new.union(old).distinct()}
    rows = [df.withColumn("part", F.lit(name)) for name, df in sets.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.groupBy("part", "yr").agg(n_rows().alias("units"), F.sum("unit_id").alias("id_sum"))
