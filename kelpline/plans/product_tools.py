"""Tools over reviews with texts and themes: search, complaints of a product, comparison of a type, ranks, product search.

A review's text is the document whose number is the order's modulo the number
of documents. Themes are patterns by name: the 24 complaint themes unless
others are given, as the queries below do, whose texts are invented words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as X
from ..operators.relational import checkpointed, unpivoted
from ..sources.readers import read_table
from .registry import RV, query
from .review_queries import COMPLETE, drift_of, failures
from .text_queries import NAMES, WORD_THEMES, word_pattern
from .tools import MOST_PRODUCTS, MOST_REVIEWS, ToolError, Tools, clamp, month


class Bars(NamedTuple):
    """Least numbers of reviews: low ratings for shares of complaints, low ratings of a year for its leading one, reviews of a year for a change; the least change."""

    low: int = 30
    year: int = 15
    change: int = 100
    rise: float = 0.10


#: Years and complaints that are listed, characters of an excerpt.
YEARS, TOP, EXCERPT = 12, 6, 350
#: Complaints about what arrived, which refurbished units are compared by.
ARRIVAL = ("missing_parts", "arrived_damaged_used", "not_as_described", "dead_on_arrival")
SERVICE = "warranty_service"
RANKS = ("reviews_new", "avg_rating_new", "low_star_share", "complaint_share", "rating_change", "refurbished_share")


class ProductTools(Tools):
    """Tools over a directory's tables. ``themes``: names and patterns of lower-cased texts; ``arrival``: those that refurbished units are compared by."""

    def __init__(self, spark: SparkSession, directory: str, themes: dict[str, str] | None = None, arrival: tuple[str, ...] = ARRIVAL, bars: Bars = Bars()):
        super().__init__(spark, directory)
        self.themes, self.arrival, self.bars = themes or X.THEMES, arrival, bars
        docs = read_table(spark, directory, "documents")
        flags = [F.coalesce(F.lower("text").rlike(p), F.lit(False)).alias(f"theme_{k}") for k, p in self.themes.items()]
        size = docs.agg(F.count(F.lit(1)).alias("n_texts"))
        numbered = self.rv.join(F.broadcast(size)).withColumn("text_id", F.col("order_key") % F.nullif("n_texts", F.lit(0)))  # a row
        self.numbered, self.texts, self.flags = numbered.drop("n_texts"), docs.select(F.col("doc_id").alias("text_id"), "text"), docs.select(F.col("doc_id").alias("text_id"), *flags)
        part = read_table(spark, directory, "part")
        model = F.concat(F.lower(F.left("p_type", F.lit(2))), F.lpad((F.col("p_size") * 7).cast("string"), 3, "0"))
        extra = part.select(F.col("p_partkey").alias("unit_id"), F.when(F.col("p_size") % 2 == 0, model).alias("model_key"), (F.col("p_size") % 10 == 9).alias("is_accessory"))
        self.catalogue = self.units.join(extra, "unit_id")

    def theme(self, phrase: str | None) -> str:
        """The theme that a phrase names, wholly or in part."""
        v = (phrase or "").strip().lower().replace("_", " ")
        for k in self.themes:
            name = k.replace("_", " ")
            if v == name or (v and v.rstrip("s") == name) or (len(v) >= 3 and v in name):
                return k
        raise ToolError(f"unknown theme: {phrase!r}; there are {', '.join(self.themes)}")

    def search(self, unit_id: int, first: str | None = None, last: str | None = None, channel: str | None = None, min_rating: int | None = None, max_rating: int | None = None,
               contains: str | None = None, theme: str | None = None, sort: str = "recent", limit: int = MOST_REVIEWS) -> DataFrame:
        """The first reviews with an excerpt of their text, and in ``matching`` how many there are in all.

        ``contains`` is looked for as it is, whatever signs it holds. Themes are
        decided once a text and only for those of the product's reviews.
        """
        if channel not in (None, "new", "refurbished"):
            raise ToolError(f"unknown channel: {channel!r}")
        if sort not in ("recent", "helpful"):
            raise ToolError(f"unknown order: {sort!r}")
        rows = self.numbered.filter(F.col("unit_id") == F.lit(self.unit(unit_id)))
        ym = F.date_format("review_date", "yyyy-MM")
        rows = rows if first is None else rows.filter(ym >= month(first, first))
        rows = rows if last is None else rows.filter(ym <= month(last, last))
        rows = rows if channel is None else rows.filter(F.col("channel") == channel)
        rows = rows if min_rating is None else rows.filter(F.col("rating") >= clamp(min_rating, 1, 5))
        rows = rows if max_rating is None else rows.filter(F.col("rating") <= clamp(max_rating, 1, 5))
        rows = rows.join(self.texts, "text_id", "left")
        if contains:
            rows = rows.filter(F.contains(F.lower("text"), F.lower(F.lit(contains.strip()))))
        if theme:
            rows = rows.filter(F.coalesce(F.lower("text").rlike(self.themes[self.theme(theme)]), F.lit(False)))
        every = rows.agg(F.count(F.lit(1)).alias("matching"))
        order = [F.col("review_date").desc()] if sort == "recent" else [F.col("helpful").desc(), F.col("review_date").desc()]
        shown = rows.orderBy(*order, "review_id").limit(clamp(limit, 1, MOST_REVIEWS))
        shown = shown.select("review_id", "review_date", F.col("rating").cast("int"), "verified", F.col("helpful").cast("int"), "channel", F.left(F.coalesce("text", F.lit("")), F.lit(EXCERPT)).alias("excerpt"))
        return shown.join(F.broadcast(every)).orderBy(*order, "review_id")  # a row

    def _shares(self, keys: list[str], where: Column | None = None) -> list[Column]:
        """Shares of low ratings that mention each theme."""
        low = F.col("low") == 1 if where is None else (F.col("low") == 1) & where
        return [F.round(F.avg(F.when(low, F.col(f"theme_{k}").cast("int"))), 4).alias(k) for k in keys]

    def _flagged(self, rows: DataFrame) -> DataFrame:
        flags = [F.coalesce(f"theme_{k}", F.lit(False)).alias(f"theme_{k}") for k in self.themes]
        return rows.join(self.flags, "text_id", "left").select(*rows.columns, *flags)

    def complaints(self, unit_id: int) -> DataFrame:
        """section, item, value, note: what owners of a product complain of.

        Sections: new_units, top_complaints (six, of the low ratings of new
        units), warranty_service, type_own and type_peers (the same complaints
        in the type's brand sets), by_year (the low share, and the leading
        complaint where the year has enough low ratings), notable_change (the
        latest rise between two whole years), rating_over_life, refurbished and
        arrival_new / arrival_refurbished. With too few low ratings of new
        units there are their numbers only.
        """
        b, keys = self.bars, list(self.themes)
        problems = [k for k in keys if k != SERVICE]
        unit = self.units.filter(F.col("unit_id") == F.lit(self.unit(unit_id))).first()
        rows = checkpointed(self._flagged(self.numbered.filter(F.col("unit_id") == F.lit(unit_id))).filter(F.col("review_date") < F.lit(COMPLETE)))
        low, line = F.sum("low"), lambda df, section, item, value, note=None: df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"), (F.lit(None) if note is None else note).cast("string").alias("note"))
        four = lambda c: F.round(c, 4)

        def numbers(df: DataFrame, section: str) -> DataFrame:
            one = df.agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("rating"), 4).alias("avg_rating"), low.alias("low_reviews"), four(F.avg("low")).alias("low_share")).filter("reviews > 0")
            one = one.select(*(F.col(c).cast("double").alias(c) for c in one.columns), F.lit(section).alias("section"))
            return line(unpivoted(one, ["section"], ["reviews", "avg_rating", "low_reviews", "low_share"], "item", "value"), section, F.col("item"), F.col("value"))

        def themes(df: DataFrame, section: str, of: list[str]) -> DataFrame:
            one = df.agg(*self._shares(of)).withColumn("section", F.lit(section))
            return line(unpivoted(one, ["section"], of, "item", "value").filter("value is not null"), section, F.col("item"), F.col("value"))

        new, old = rows.filter("channel = 'new'"), rows.filter("channel = 'refurbished'")
        out = numbers(new, "new_units")
        n_low = new.agg(F.coalesce(low, F.lit(0))).first()[0]
        if n_low < b.low:
            return out
        top = checkpointed(themes(new, "top_complaints", problems).orderBy(F.col("value").desc(), F.array_position(F.array(*map(F.lit, problems)), F.col("item"))).limit(TOP))
        kind = self._flagged(self.numbered.filter((F.col("product_type") == F.lit(unit["product_type"])) & (F.col("channel") == "new") & (F.col("low") == 1)))
        parts = [out, top, *([themes(new, SERVICE, [SERVICE])] if SERVICE in keys else [])]
        for brands in ("Own", "Peers"):
            reference = themes(kind.filter(F.col("brand_set") == brands), f"type_{brands.lower()}", problems)
            parts.append(reference.join(F.broadcast(top.select("item")), "item", "left_semi").select(*out.columns))  # six rows
        years = new.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.avg("low").alias("share"), low.alias("n_low"), *self._shares(problems))
        years = checkpointed(years.withColumn("leads", F.when(F.col("n_low") >= b.year, _leading(problems))))  # a row a year
        parts.append(line(years.orderBy(F.col("yr").desc()).limit(YEARS), "by_year", F.col("yr").cast("string"), four(F.col("share")), F.col("leads")))
        before = years.select((F.col("yr") + 1).alias("yr"), F.col("share").alias("share0"), F.col("n").alias("n0"))
        rise = years.join(before, "yr").filter((F.col("n") >= b.change) & (F.col("n0") >= b.change) & (F.col("yr") < COMPLETE.year) & (F.round(F.col("share") - F.col("share0"), 9) >= b.rise))
        parts.append(line(rise.orderBy(F.col("yr").desc()).limit(1), "notable_change", F.concat((F.col("yr") - 1).cast("string"), F.lit("-"), F.col("yr").cast("string")), four(F.col("share") - F.col("share0")), F.col("leads")))
        life = drift_of(self.rv.filter(F.col("unit_id") == F.lit(unit_id)), 3).select(F.lit("x").alias("k"), "r1", "r3", "change")
        parts.append(line(unpivoted(life, ["k"], ["r1", "r3", "change"], "item", "value"), "rating_over_life", F.col("item"), four(F.col("value"))))
        parts.append(numbers(old, "refurbished"))
        if old.agg(F.coalesce(low, F.lit(0))).first()[0] >= b.low:
            parts += [themes(new, "arrival_new", list(self.arrival)), themes(old, "arrival_refurbished", list(self.arrival))]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compare_type(self, kind: str) -> DataFrame:
        """section, item, own, peers: two brand sets in a type; without enough peers' reviews ``peers`` is null all over.

        Sections: low_reviews, top_complaints (five of own), largest_gaps
        (three), rating_change (units with both ends, and their mean change) and
        time_to_failure (reviews that state one, median months, share under a year).
        """
        kind, problems = self.product_type(kind), [k for k in self.themes if k != SERVICE]
        rows = self.numbered.filter((F.col("product_type") == F.lit(kind)) & (F.col("channel") == "new"))
        low = self._flagged(rows.filter("low = 1")).groupBy("brand_set").agg(F.count(F.lit(1)).alias("low_reviews"), *self._shares(problems))
        low = checkpointed(low)  # a row a brand set
        enough = low.filter(F.col("brand_set") == "Peers").filter(F.col("low_reviews") >= self.bars.low).limit(1).count() == 1

        def sides(df: DataFrame, section: str, items: list[str]) -> DataFrame:
            doubles = df.select("brand_set", *(F.col(i).cast("double").alias(i) for i in items))
            long = unpivoted(doubles, ["brand_set"], items, "item", "value")
            side = lambda s: F.max(F.when(F.col("brand_set") == s, F.col("value")))
            peers = side("Peers") if enough else F.lit(None).cast("double")
            return long.groupBy(F.lit(section).alias("section"), "item").agg(F.round(side("Own"), 4).alias("own"), F.round(peers, 4).alias("peers")).filter("own is not null")

        shares, place = sides(low, "top_complaints", problems), F.array_position(F.array(*map(F.lit, problems)), F.col("item"))
        drift = drift_of(self.rv.filter(F.col("product_type") == F.lit(kind)), 3).groupBy("brand_set").agg(F.count(F.lit(1)).alias("units"), F.avg("change").alias("mean_change"))
        fail = failures(self.spark, self.directory).filter(F.col("product_type") == F.lit(kind)).groupBy("brand_set")
        fail = fail.agg(F.count(F.lit(1)).alias("stated"), F.median("months").alias("median_months"), F.avg((F.col("months") < 12).cast("int")).alias("under_year"))
        parts = [sides(low, "low_reviews", ["low_reviews"]), shares.orderBy(F.col("own").desc(), place).limit(5)]
        if enough:
            parts.append(shares.orderBy(F.round(F.col("own") - F.coalesce("peers", F.lit(0.0)), 4).desc(), place).limit(3).withColumn("section", F.lit("largest_gaps")))
        parts += [sides(drift, "rating_change", ["units", "mean_change"]), sides(fail, "time_to_failure", ["stated", "median_months", "under_year"])]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def rank(self, metric: str, kind: str | None = None, family: str | None = None, theme: str | None = None, min_reviews: int = 100, limit: int = MOST_PRODUCTS) -> DataFrame:
        """unit_id, model_key, title, product_type, reviews_new, value of the first products; accessories don't rank."""
        if metric not in RANKS:
            raise ToolError(f"unknown metric: {metric!r}")
        named = self.theme(theme) if metric == "complaint_share" else None
        there = self.catalogue.filter(~F.col("is_accessory"))
        there = there if kind is None else there.filter(F.col("product_type") == F.lit(self.product_type(kind)))
        there = there if family is None else there.filter(F.lower("brand") == F.lit(family.strip().lower()))
        new, old = F.col("channel") == "new", F.col("channel") == "refurbished"
        rows = self.numbered.join(there.select("unit_id"), "unit_id", "left_semi")
        n = F.count(F.when(new, 1)).alias("reviews_new")
        if metric == "rating_change":
            value = drift_of(self.rv.join(there.select("unit_id"), "unit_id", "left_semi"), 3).select("unit_id", F.col("change").alias("value"))
            found = rows.groupBy("unit_id").agg(n).join(value, "unit_id")
        else:
            if metric == "complaint_share":
                rows = rows.join(self.flags.select("text_id", f"theme_{named}"), "text_id", "left")
                value = F.when(F.sum(F.when(new, F.col("low"))) >= self.bars.low, F.avg(F.when(new & (F.col("low") == 1), F.coalesce(f"theme_{named}", F.lit(False)).cast("int"))))
            else:
                value = {
                    "reviews_new": F.count(F.when(new, 1)).cast("double"), "avg_rating_new": F.avg(F.when(new, F.col("rating"))), "refurbished_share": F.avg(old.cast("int")),
                    "low_star_share": F.when(F.sum(F.when(new, F.col("low"))) >= self.bars.low, F.avg(F.when(new, F.col("low")))),
                }[metric]
            found = rows.groupBy("unit_id").agg(n, value.alias("value"))
        found = found.filter(F.col("reviews_new") >= max(0, min_reviews)).filter("value is not null").withColumn("value", F.round("value", 4))
        order = F.col("value").asc() if metric == "rating_change" else F.col("value").desc()
        first = found.orderBy(order, "unit_id").limit(clamp(limit, 1, MOST_PRODUCTS))
        return first.join(self.catalogue.select("unit_id", "model_key", "title", "product_type"), "unit_id").select("unit_id", "model_key", "title", "product_type", "reviews_new", "value").orderBy(order, "unit_id")

    def find(self, text: str, kind: str | None = None, family: str | None = None, include_accessories: bool = False, limit: int = MOST_PRODUCTS) -> DataFrame:
        """Products whose model or family holds the text, or whose title holds all its words, by number of reviews."""
        if not text or not text.strip():
            raise ToolError("a text to look for is needed")
        holds = lambda c, x: F.coalesce(F.contains(F.lower(c), F.lower(F.lit(x))), F.lit(False))
        words = F.lit(True)
        for w in text.split():
            words = words & holds("title", w)
        there = self.catalogue.filter(words | holds("model_key", text.strip()) | holds("brand", text.strip()))
        there = there if kind is None else there.filter(F.col("product_type") == F.lit(self.product_type(kind)))
        there = there if family is None else there.filter(F.col("brand") == F.lit(family))
        there = there if include_accessories else there.filter(~F.col("is_accessory"))
        counts = self.rv.groupBy("unit_id").agg(F.count(F.when(F.col("channel") == "new", 1)).alias("reviews_new"), F.count(F.when(F.col("channel") == "refurbished", 1)).alias("reviews_refurbished"))
        found = there.join(counts, "unit_id", "left").fillna(0, ["reviews_new", "reviews_refurbished"])
        first = found.orderBy((F.col("reviews_new") + F.col("reviews_refurbished")).desc(), "unit_id").limit(clamp(limit, 1, MOST_PRODUCTS))
        return first.select("unit_id", "model_key", "title", "product_type", F.col("brand").alias("family"), "is_accessory", "reviews_new", "reviews_refurbished")


def _leading(keys: list[str]) -> Column:
    """The name of the largest share, the first of equals; null if none is above 0."""
    best = F.array_max(F.array(*(F.struct(F.coalesce(F.col(k), F.lit(0.0)).alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(keys))))
    return F.when(best["v"] > 0, best["k"])


#: Bars for units of some thirty reviews, as the bound tables have.
SMALL = Bars(low=3, year=2, change=3, rise=0.1)
THEMES = {k: word_pattern(p) for k, p in WORD_THEMES.items()}

TEXT_SQL = RV.replace("END AS brand_set\n", "END AS brand_set, l_orderkey % (SELECT count(*) FROM documents) AS text_id, l_linenumber AS helpful\n", 1) + ", rt AS (SELECT rv.*, coalesce(text, '') AS text, " + ", ".join(rf"coalesce(regexp_matches(lower(text), '\b({p})\b'), false)::INT AS t_{k}" for k, p in WORD_THEMES.items()) + " FROM rv LEFT JOIN documents ON doc_id = text_id),\ncat AS (SELECT p_partkey AS unit_id, p_name AS title, p_brand AS brand, p_type AS product_type, CASE WHEN p_size % 2 = 0 THEN concat(lower(left(p_type, 2)), lpad(CAST(p_size * 7 AS VARCHAR), 3, '0')) END AS model_key, p_size % 10 = 9 AS is_accessory FROM part)\n"
_ITEMS = "[" + ", ".join(f"{{'k': '{k}', 'i': {i}, 'v': t_{k}}}" for i, k in enumerate(NAMES)) + "]"


def tools_of(spark: SparkSession, d: str) -> ProductTools:
    return ProductTools(spark, d, THEMES, tuple(NAMES[:2]), SMALL)


@query("tool_search_text", TEXT_SQL + ", m AS (SELECT * FROM rt WHERE unit_id = 2 AND contains(lower(text), 'the') AND strftime(review_date, '%Y-%m') BETWEEN '1993-01' AND '2000-12') SELECT review_id, review_date, CAST(rating AS INT) AS rating, verified, CAST(helpful AS INT) AS helpful, channel, left(text, 350) AS excerpt, (SELECT count(*) FROM m) AS matching FROM m ORDER BY helpful DESC, review_date DESC, review_id LIMIT 15")
def tool_search_text(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).search(2, "1993-01", "2000-12", contains="The", sort="helpful", limit=99)


@query("tool_search_theme", TEXT_SQL + ", m AS (SELECT * FROM rt WHERE unit_id = 3 AND t_that = 1 AND channel = 'new' AND rating BETWEEN 1 AND 4) SELECT review_id, review_date, CAST(rating AS INT) AS rating, verified, CAST(helpful AS INT) AS helpful, channel, left(text, 350) AS excerpt, (SELECT count(*) FROM m) AS matching FROM m ORDER BY review_date DESC, review_id LIMIT 5")
def tool_search_theme(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).search(3, channel="new", min_rating=0, max_rating=4, theme="That", limit=5)


_SECTION = "SELECT '{s}' AS section, x.k AS item, round(x.v, 4) AS value, CAST(NULL AS VARCHAR) AS note FROM (SELECT unnest([{{'k': 'reviews', 'v': n}}, {{'k': 'avg_rating', 'v': r}}, {{'k': 'low_reviews', 'v': nl}}, {{'k': 'low_share', 'v': l}}]) AS x FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(rating) AS r, CAST(sum(low) AS DOUBLE) AS nl, avg(low) AS l FROM w WHERE channel = '{c}') WHERE n > 0)"


@query("tool_product_complaints", TEXT_SQL + f""", w AS (SELECT * FROM rt WHERE unit_id = 4 AND review_date < DATE '2001-06-01'),
k AS (SELECT channel, low, yr, unnest({_ITEMS}) AS x FROM w),
tops AS (SELECT x.k AS item, x.i AS i, round(avg(x.v), 4) AS value FROM k WHERE channel = 'new' AND low = 1 GROUP BY 1, 2 ORDER BY value DESC, i LIMIT 6),
ty AS (SELECT brand_set, unnest({_ITEMS}) AS x FROM rt WHERE product_type = (SELECT p_type FROM part WHERE p_partkey = 4) AND channel = 'new' AND low = 1),
ys AS (SELECT yr, count(*) AS n, avg(low) AS share, sum(low) AS n_low FROM w WHERE channel = 'new' GROUP BY 1),
yk AS (SELECT yr, x.k AS item, row_number() OVER (PARTITION BY yr ORDER BY round(avg(x.v), 4) DESC, x.i) AS rn, avg(x.v) AS v FROM k WHERE channel = 'new' AND low = 1 GROUP BY yr, x.k, x.i),
yl AS (SELECT ys.*, CASE WHEN n_low >= 2 AND v > 0 THEN item END AS leads FROM ys LEFT JOIN yk ON yk.yr = ys.yr AND rn = 1),
dr AS (SELECT count(*) FILTER (WHERE age_m < 12) AS n1, count(*) FILTER (WHERE age_m BETWEEN 24 AND 47) AS n3, avg(rating) FILTER (WHERE age_m < 12) AS r1, avg(rating) FILTER (WHERE age_m BETWEEN 24 AND 47) AS r3 FROM rv WHERE channel = 'new' AND unit_id = 4),
al AS ({_SECTION.format(s="new_units", c="new")} UNION ALL SELECT 'top_complaints', item, value, NULL FROM tops
  UNION ALL SELECT concat('type_', lower(brand_set)), x.k, round(avg(x.v), 4), NULL FROM ty WHERE x.k IN (SELECT item FROM tops) GROUP BY brand_set, x.k
  UNION ALL SELECT 'by_year', CAST(yr AS VARCHAR), round(share, 4), leads FROM (SELECT * FROM yl ORDER BY yr DESC LIMIT 12)
  UNION ALL SELECT * FROM (SELECT 'notable_change', concat(a.yr, '-', b.yr), round(b.share - a.share, 4), b.leads FROM yl a JOIN yl b ON b.yr = a.yr + 1 WHERE a.n >= 3 AND b.n >= 3 AND b.yr < 2001 AND round(b.share - a.share, 9) >= 0.1 ORDER BY b.yr DESC LIMIT 1)
  UNION ALL SELECT 'rating_over_life', x.k, round(x.v, 4), NULL FROM (SELECT unnest([{{'k': 'r1', 'v': round(r1, 6)}}, {{'k': 'r3', 'v': round(r3, 6)}}, {{'k': 'change', 'v': round(r3 - r1, 6)}}]) AS x FROM dr WHERE n1 >= 3 AND n3 >= 3)
  UNION ALL {_SECTION.format(s="refurbished", c="refurbished")}
  UNION ALL SELECT concat('arrival_', channel), x.k, round(avg(x.v), 4), NULL FROM k WHERE low = 1 AND x.i < 2 AND (SELECT sum(low) FROM w WHERE channel = 'refurbished') >= 3 GROUP BY channel, x.k)
SELECT * FROM al WHERE section = 'new_units' OR (SELECT sum(low) FROM w WHERE channel = 'new') >= 3""")
def tool_product_complaints(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).complaints(4)


@query("tool_type_comparison", TEXT_SQL + f""", ty AS (SELECT brand_set, unnest({_ITEMS}) AS x FROM rt WHERE product_type = 'ECONOMY' AND channel = 'new' AND low = 1),
s AS (SELECT x.k AS item, x.i AS i, round(avg(x.v) FILTER (WHERE brand_set = 'Own'), 4) AS own, round(avg(x.v) FILTER (WHERE brand_set = 'Peers'), 4) AS peers FROM ty GROUP BY 1, 2),
d0 AS (SELECT brand_set, unit_id, round(avg(rating) FILTER (WHERE age_m BETWEEN 24 AND 47) - avg(rating) FILTER (WHERE age_m < 12), 6) AS change FROM rv WHERE channel = 'new' AND product_type = 'ECONOMY' GROUP BY 1, 2 HAVING count(*) FILTER (WHERE age_m < 12) >= 3 AND count(*) FILTER (WHERE age_m BETWEEN 24 AND 47) >= 3),
fl AS (SELECT brand_set, months FROM rv WHERE low = 1 AND months <= 72 AND product_type = 'ECONOMY'),
al AS (SELECT 'low_reviews' AS section, 'low_reviews' AS item, CAST(sum(low) FILTER (WHERE brand_set = 'Own') AS DOUBLE) AS own, CAST(sum(low) FILTER (WHERE brand_set = 'Peers') AS DOUBLE) AS peers FROM rv WHERE product_type = 'ECONOMY' AND channel = 'new'
  UNION ALL SELECT * FROM (SELECT 'top_complaints', item, own, peers FROM s ORDER BY own DESC, i LIMIT 5) UNION ALL SELECT * FROM (SELECT 'largest_gaps', item, own, peers FROM s ORDER BY round(own - peers, 4) DESC, i LIMIT 3)
  UNION ALL SELECT 'rating_change', 'units', CAST(count(*) FILTER (WHERE brand_set = 'Own') AS DOUBLE), CAST(count(*) FILTER (WHERE brand_set = 'Peers') AS DOUBLE) FROM d0 UNION ALL SELECT 'rating_change', 'mean_change', round(avg(change) FILTER (WHERE brand_set = 'Own'), 4), round(avg(change) FILTER (WHERE brand_set = 'Peers'), 4) FROM d0
  UNION ALL SELECT 'time_to_failure', 'stated', CAST(count(*) FILTER (WHERE brand_set = 'Own') AS DOUBLE), CAST(count(*) FILTER (WHERE brand_set = 'Peers') AS DOUBLE) FROM fl UNION ALL SELECT 'time_to_failure', 'median_months', median(months) FILTER (WHERE brand_set = 'Own'), median(months) FILTER (WHERE brand_set = 'Peers') FROM fl
  UNION ALL SELECT 'time_to_failure', 'under_year', round(avg(CAST(months < 12 AS INT)) FILTER (WHERE brand_set = 'Own'), 4), round(avg(CAST(months < 12 AS INT)) FILTER (WHERE brand_set = 'Peers'), 4) FROM fl)
SELECT * FROM al""")
def tool_type_comparison(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).compare_type("Economys")


_RANK = TEXT_SQL + ", r AS (SELECT c.unit_id, model_key, c.title, c.product_type, count(*) FILTER (WHERE channel = 'new') AS reviews_new, round({value}, 4) AS value FROM rt JOIN cat c USING (unit_id) WHERE NOT is_accessory{where} GROUP BY ALL HAVING reviews_new >= {least}) SELECT unit_id, model_key, title, product_type, CAST(reviews_new AS BIGINT) AS reviews_new, value FROM r WHERE value IS NOT NULL ORDER BY value {way}, unit_id LIMIT 10"


@query("tool_rank_theme", _RANK.format(value="CASE WHEN sum(low) FILTER (WHERE channel = 'new') >= 3 THEN avg(t_and) FILTER (WHERE channel = 'new' AND low = 1) END", where=" AND lower(c.brand) = 'brand#3'", least=5, way="DESC"))
def tool_rank_theme(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).rank("complaint_share", family="BRAND#3", theme="and", min_reviews=5)


@query("tool_rank_change", _RANK.format(value="CASE WHEN count(*) FILTER (WHERE channel = 'new' AND age_m < 12) >= 3 AND count(*) FILTER (WHERE channel = 'new' AND age_m BETWEEN 24 AND 47) >= 3 THEN round(avg(rating) FILTER (WHERE channel = 'new' AND age_m BETWEEN 24 AND 47) - avg(rating) FILTER (WHERE channel = 'new' AND age_m < 12), 6) END", where="", least=0, way="ASC"))
def tool_rank_change(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).rank("rating_change", min_reviews=0)


@query("tool_rank_refurbished", _RANK.format(value="avg(CAST(channel = 'refurbished' AS INT))", where=" AND c.product_type = 'SMALL'", least=10, way="DESC"))
def tool_rank_refurbished(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).rank("refurbished_share", kind="small", min_reviews=10)


@query("tool_find_model", TEXT_SQL + ", n AS (SELECT unit_id, count(*) FILTER (WHERE channel = 'new') AS a, count(*) FILTER (WHERE channel = 'refurbished') AS b FROM rv GROUP BY 1) SELECT unit_id, model_key, title, product_type, brand AS family, is_accessory, CAST(coalesce(a, 0) AS BIGINT) AS reviews_new, CAST(coalesce(b, 0) AS BIGINT) AS reviews_refurbished FROM cat LEFT JOIN n USING (unit_id) WHERE (contains(lower(title), 'la14') OR contains(coalesce(model_key, ''), 'la14') OR contains(lower(brand), 'la14')) AND NOT is_accessory ORDER BY coalesce(a, 0) + coalesce(b, 0) DESC, unit_id LIMIT 10")
def tool_find_model(spark: SparkSession, d: str) -> DataFrame:
    return tools_of(spark, d).find("LA14")
