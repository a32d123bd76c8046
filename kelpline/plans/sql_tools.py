"""The nine tools as SQL table functions: arguments are bound by name, never put into the text.

``register_tools`` makes views of a directory's tables and temporary functions
over them; ``call`` asks one with parameter markers. Limits are clamped inside,
as by the DataFrame tools, whose rows these return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .product_tools import EXCERPT, TEXT_SQL, ProductTools, tools_of
from .registry import RV, query
from .review_queries import COMPLETE, cases, drift_of, failures
from .tools import FIRST_MONTH, LAST_MONTH, MOST_CASES, MOST_PRODUCTS, MOST_REVIEWS, ToolError

_MONTHS = f"greatest('{FIRST_MONTH}', least('{LAST_MONTH}', least(coalesce(first, '{FIRST_MONTH}'), coalesce(last, '{LAST_MONTH}'))))", f"greatest('{FIRST_MONTH}', least('{LAST_MONTH}', greatest(coalesce(first, '{FIRST_MONTH}'), coalesce(last, '{LAST_MONTH}'))))"


def _clamped(most: int) -> str:
    return f"greatest(1, least({most}, coalesce(top, {most})))"


#: Name, parameters, columns, body. Bodies read the views tool_reviews, tool_catalogue, tool_cases_of, tool_drift, tool_failures.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    ("find_products", "wanted STRING, kind STRING DEFAULT NULL, line STRING DEFAULT NULL, accessories BOOLEAN DEFAULT false, top INT DEFAULT NULL",
     "unit_id BIGINT, model_key STRING, title STRING, product_type STRING, family STRING, is_accessory BOOLEAN, reviews_new BIGINT, reviews_refurbished BIGINT",
     f"""SELECT unit_id, model_key, title, product_type, family, is_accessory, reviews_new, reviews_refurbished FROM (
       SELECT c.*, row_number() OVER (ORDER BY reviews_new + reviews_refurbished DESC, unit_id) AS place FROM tool_catalogue c
       WHERE (forall(filter(split(trim(wanted), '\\\\s+'), w -> w <> ''), w -> contains(lower(title), lower(w))) OR contains(lower(coalesce(model_key, '')), lower(trim(wanted))) OR contains(lower(family), lower(trim(wanted))))
         AND trim(wanted) <> '' AND (kind IS NULL OR lower(product_type) IN (lower(trim(kind)), rtrim('s', lower(trim(kind))))) AND (line IS NULL OR family = line) AND (accessories OR NOT is_accessory))
       WHERE place <= {_clamped(MOST_PRODUCTS)}"""),
    ("product_timeline", "product BIGINT, first STRING DEFAULT NULL, last STRING DEFAULT NULL, way STRING DEFAULT 'both'",
     "period STRING, reviews BIGINT, avg_rating DOUBLE, complete BOOLEAN",
     f"""SELECT period, count(1), round(avg(rating), 4), bool_and(review_date < DATE '{COMPLETE}') FROM (
       SELECT *, CASE WHEN months_between(to_date(concat({_MONTHS[1]}, '-01')), to_date(concat({_MONTHS[0]}, '-01'))) + 1 > 48 THEN concat(year(review_date), '-Q', quarter(review_date)) ELSE ym END AS period
       FROM tool_reviews WHERE unit_id = product AND ym BETWEEN {_MONTHS[0]} AND {_MONTHS[1]} AND (way = 'both' OR channel = way)) GROUP BY period"""),
    ("product_complaints", "product BIGINT", "complaint STRING, product_share DOUBLE, type_share DOUBLE",
     """SELECT complaint, round(avg(CASE WHEN asked THEN v END), 4), round(avg(v), 4) FROM (
       SELECT r.unit_id = of_unit AS asked, stack(4, 'early', int(months < 4), 'first_year', int(months < 12), 'carried_over', int(before_launch), 'verified', int(verified)) AS (complaint, v)
       FROM tool_reviews r JOIN (SELECT product_type AS own, unit_id AS of_unit FROM tool_catalogue WHERE unit_id = product) ON r.product_type = own WHERE low = 1) GROUP BY complaint"""),
    ("compare_product_type", "kind STRING", "brand_set STRING, reviews BIGINT, low_share DOUBLE, median_months DOUBLE, avg_rating DOUBLE",
     "SELECT brand_set, count(1), round(avg(low), 6), median(months), round(avg(rating), 6) FROM tool_reviews WHERE lower(product_type) IN (lower(trim(kind)), rtrim('s', lower(trim(kind)))) GROUP BY brand_set"),
    ("find_cases", "kind STRING DEFAULT NULL, top INT DEFAULT NULL", "product_type STRING, brand STRING, yr INT, jump DOUBLE, baseline DOUBLE, excess DOUBLE",
     f"""SELECT product_type, brand, yr, jump, baseline, excess FROM (SELECT *, row_number() OVER (ORDER BY excess DESC, product_type, brand) AS place FROM tool_cases_of
       WHERE kind IS NULL OR lower(product_type) IN (lower(trim(kind)), rtrim('s', lower(trim(kind))))) WHERE place <= {_clamped(MOST_CASES)}"""),
    ("rank_products", "metric STRING, least INT DEFAULT 10, top INT DEFAULT NULL", "unit_id BIGINT, reviews BIGINT, value DOUBLE",
     f"""SELECT unit_id, reviews, value FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN metric IN ('lowest_rated', 'rating_change') THEN value ELSE -value END, unit_id) AS place FROM (
       SELECT unit_id, n AS reviews, round(CASE metric WHEN 'most_reviewed' THEN double(n) WHEN 'highest_rated' THEN mean WHEN 'lowest_rated' THEN mean WHEN 'low_share' THEN share WHEN 'early_failures' THEN early END, 6) AS value
         FROM (SELECT unit_id, count(1) AS n, avg(rating) AS mean, avg(low) AS share, avg(CASE WHEN low = 1 THEN int(months < 4) END) AS early FROM tool_reviews GROUP BY unit_id)
       UNION ALL SELECT unit_id, n1 + n3, change FROM tool_drift WHERE metric = 'rating_change') WHERE reviews >= greatest(1, least) AND value IS NOT NULL) WHERE place <= {_clamped(MOST_PRODUCTS)}"""),
    ("findings", "", "units BIGINT, fell BIGINT, median_months DOUBLE, failures BIGINT, low_share DOUBLE, reviews BIGINT",
     """SELECT d.units, d.fell, f.median_months, f.failures, r.low_share, r.reviews FROM (SELECT count(1) AS units, sum(bigint(change < 0)) AS fell FROM tool_drift) d
       CROSS JOIN (SELECT median(months) AS median_months, count(1) AS failures FROM tool_failures) f CROSS JOIN (SELECT round(avg(low), 6) AS low_share, count(1) AS reviews FROM tool_reviews) r"""),
    ("search_reviews", "product BIGINT, first STRING DEFAULT NULL, last STRING DEFAULT NULL, way STRING DEFAULT NULL, least INT DEFAULT NULL, most INT DEFAULT NULL, wanted STRING DEFAULT NULL, by_help BOOLEAN DEFAULT false, top INT DEFAULT NULL",
     "review_id STRING, review_date DATE, rating INT, verified BOOLEAN, helpful INT, channel STRING, excerpt STRING, matching BIGINT",
     f"""SELECT review_id, review_date, rating, verified, helpful, channel, left(text, {EXCERPT}), matching FROM (
       SELECT *, count(1) OVER () AS matching, row_number() OVER (ORDER BY CASE WHEN by_help THEN helpful END DESC, review_date DESC, review_id) AS place FROM (
         SELECT r.*, coalesce(t.text, '') AS text FROM tool_reviews r LEFT JOIN tool_texts t ON t.text_id = r.text_id
         WHERE unit_id = product AND (first IS NULL OR ym >= least(greatest(left(first, 7), '{FIRST_MONTH}'), '{LAST_MONTH}')) AND (last IS NULL OR ym <= least(greatest(left(last, 7), '{FIRST_MONTH}'), '{LAST_MONTH}'))
           AND (way IS NULL OR channel = way) AND (least IS NULL OR rating >= greatest(1, least(5, least))) AND (most IS NULL OR rating <= greatest(1, least(5, most))) AND (wanted IS NULL OR contains(lower(t.text), lower(trim(wanted))))))
       WHERE place <= {_clamped(MOST_REVIEWS)}"""),
    ("set_view", "product BIGINT, first STRING DEFAULT NULL, last STRING DEFAULT NULL, measure STRING DEFAULT 'reviews'", "unit_id BIGINT, first STRING, last STRING, measure STRING",
     f"SELECT product, greatest({_MONTHS[0]}, a), least({_MONTHS[1]}, z), CASE measure WHEN 'reviews' THEN 'volume' ELSE measure END FROM (SELECT min(ym) AS a, max(ym) AS z FROM tool_reviews WHERE unit_id = product)"),
]


def register_tools(spark: SparkSession, d: str, tools: ProductTools | None = None) -> None:
    """Temporary views and functions of the session over a directory's tables; a later call binds them to another one."""
    t = tools or tools_of(spark, d)
    counts = t.rv.groupBy("unit_id").agg(F.count(F.when(F.col("channel") == "new", 1)).alias("reviews_new"), F.count(F.when(F.col("channel") == "refurbished", 1)).alias("reviews_refurbished"))
    views = {
        "tool_reviews": t.numbered.withColumn("ym", F.date_format("review_date", "yyyy-MM")), "tool_texts": t.texts, "tool_cases_of": cases(t.rv), "tool_drift": drift_of(t.rv, 3), "tool_failures": failures(spark, d),
        "tool_catalogue": t.catalogue.withColumnRenamed("brand", "family").join(counts, "unit_id", "left").fillna(0, ["reviews_new", "reviews_refurbished"]),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, parameters, columns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")


def call(spark: SparkSession, tool: str, **arguments: str | int | bool | None) -> DataFrame:
    """The rows of a registered tool; arguments are bound to parameter markers, whatever signs they hold."""
    known = {name: [p.split()[0] for p in parameters.split(", ")] if parameters else [] for name, parameters, _, _ in FUNCTIONS}
    if tool not in known:
        raise ToolError(f"unknown tool: {tool!r}")
    odd = set(arguments) - set(known[tool])
    if odd:
        raise ToolError(f"unknown arguments: {sorted(odd)}")
    marks = ", ".join(f"{k} => :{k}" for k in arguments)
    return spark.sql(f"SELECT * FROM {tool}({marks})", args=arguments)


@query("sql_rank_products", RV + "SELECT unit_id, CAST(count(*) AS BIGINT) AS reviews, round(avg(low), 6) AS value FROM rv GROUP BY 1 HAVING count(*) >= 20 ORDER BY value DESC, unit_id LIMIT 7")
def sql_rank_products(spark: SparkSession, d: str) -> DataFrame:
    register_tools(spark, d)
    return call(spark, "rank_products", metric="low_share", least=20, top=7)


@query("sql_product_timeline", RV + "SELECT strftime(review_date, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS reviews, round(avg(rating), 4) AS avg_rating, bool_and(review_date < DATE '2001-06-01') AS complete FROM rv WHERE unit_id = 2 AND strftime(review_date, '%Y-%m') BETWEEN '1994-03' AND '1997-02' GROUP BY 1")
def sql_product_timeline(spark: SparkSession, d: str) -> DataFrame:
    register_tools(spark, d)
    return call(spark, "product_timeline", product=2, first="1997-02", last="1994-03")


@query("sql_search_reviews", TEXT_SQL + ", m AS (SELECT * FROM rt WHERE unit_id = 5 AND contains(lower(text), 'en') AND rating <= 3) SELECT review_id, review_date, CAST(rating AS INT) AS rating, verified, CAST(helpful AS INT) AS helpful, channel, left(text, 350) AS excerpt, (SELECT count(*) FROM m) AS matching FROM m ORDER BY review_date DESC, review_id LIMIT 15")
def sql_search_reviews(spark: SparkSession, d: str) -> DataFrame:
    register_tools(spark, d)
    return call(spark, "search_reviews", product=5, wanted="EN", most=3)
