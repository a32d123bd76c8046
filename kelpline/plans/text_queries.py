"""Named queries on texts and matching: themes, rules, tokens, pairs, resolution, profiles, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import THEMES
from ..functions.rules import core_model, model_tokens, price_similarity, product_type, score_features, theme_flags
from ..functions.text import excerpt, house_style, norm_brand, norm_text, parse_price, title_numbers, title_tokens
from ..operators.matching import best_after
from ..operators.quantiles import exact_quantiles
from ..operators.relational import checkpointed, column_profile, confusion, first_rows, label_components, new_folder, top_of_row, unpivoted
from ..operators.text_index import search, write_index
from ..operators.typed_pairs import each_item, each_pair, pair_count, price_bounds, type_pairs
from ..sources.readers import read_table
from .registry import query

#: Themes for texts without complaints in English: ASCII patterns that stand as words.
WORD_THEMES = {"the": "the|der|die|das", "and": "and|und|et", "that": "that|que|dass", "this": "this|este|cette"}


def word_pattern(words: str) -> str:
    """A pattern for whole words, with ASCII letters, digits and underscores as word characters, as RE2 has them."""
    return rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"


def flagged(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", "lang", "text", *(F.lower("text").rlike(word_pattern(p)).alias(k) for k, p in WORD_THEMES.items()))


FLAGS_SQL = "WITH f AS (SELECT doc_id, lang, text, " + ", ".join(rf"regexp_matches(lower(text), '\b({p})\b') AS {'"' + k + '"'}" for k, p in WORD_THEMES.items()) + " FROM documents)\n"
NAMES = list(WORD_THEMES)


@query("theme_flags", FLAGS_SQL + 'SELECT doc_id, lang, "the", "and", "that", "this" FROM f')
def theme_flags_query(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).drop("text")


@query("complaint_themes_24", " UNION ALL ".join(f"SELECT '{k}' AS theme, CAST(count(*) FILTER (WHERE regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}')) AS BIGINT) AS documents FROM documents" for k, p in THEMES.items()))
def complaint_themes(spark: SparkSession, d: str) -> DataFrame:
    """The number of documents of each complaint theme."""
    flags = read_table(spark, d, "documents").select(*theme_flags(F.col("text")))
    counts = flags.agg(*(F.sum(F.col(k).cast("long")).alias(k) for k in THEMES))
    return unpivoted(counts.withColumn("all", F.lit("all")), ["all"], list(THEMES), "theme", "documents").drop("all")


@query("theme_share_by_type", FLAGS_SQL + "SELECT lang, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f'round(avg(CAST("{k}" AS INT)), 6) AS share_{k}' for k in NAMES) + " FROM f GROUP BY 1")
def theme_share_by_type(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(k).cast("int")), 6).alias(f"share_{k}") for k in NAMES))


@query("theme_coverage", FLAGS_SQL + 'SELECT lang, round(avg(CAST("the" OR "and" OR "that" OR "this" AS INT)), 6) AS covered FROM f GROUP BY 1')
def theme_coverage(spark: SparkSession, d: str) -> DataFrame:
    covered = F.greatest(*(F.col(k) for k in NAMES))
    return flagged(spark, d).groupBy("lang").agg(F.round(F.avg(covered.cast("int")), 6).alias("covered"))


@query("theme_top_k", FLAGS_SQL + ", u AS (" + " UNION ALL ".join(f"""SELECT lang, '{k}' AS theme, round(avg(CAST("{k}" AS INT)), 6) AS part FROM f GROUP BY 1""" for k in NAMES) + ") SELECT lang, theme, part, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY part DESC, theme) AS rn FROM u) WHERE rn <= 2")
def theme_top_k(spark: SparkSession, d: str) -> DataFrame:
    shares = flagged(spark, d).groupBy("lang").agg(*(F.round(F.avg(F.col(k).cast("int")), 6).alias(k) for k in NAMES))
    w = Window.partitionBy("lang").orderBy(F.col("part").desc(), "theme")
    return unpivoted(shares, ["lang"], NAMES, "theme", "part").withColumn("place", F.row_number().over(w)).filter("place <= 2")


@query("top_theme_of_row", FLAGS_SQL + """, s AS (SELECT lang, avg(CAST("the" AS INT)) AS t0, avg(CAST("and" AS INT)) AS t1 FROM f GROUP BY 1) SELECT lang, CASE WHEN t0 >= t1 THEN 'the' ELSE 'and' END AS top FROM s""")
def top_theme_of_row(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).groupBy("lang").agg(*(F.avg(F.col(k).cast("int")).alias(k) for k in NAMES[:2])).select("lang", top_of_row(NAMES[:2]).alias("top"))


@query("norm_text", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(concat(p_name, ' -- (', p_brand, ')!')), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS norm, nullif(trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '') AS brand_norm FROM part")
def norm_text_query(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat("p_name", F.lit(" -- ("), "p_brand", F.lit(")!"))
    return read_table(spark, d, "part").select("p_partkey", norm_text(c).alias("norm"), norm_brand(F.col("p_brand")).alias("brand_norm"))


@query("parse_price", "SELECT p_partkey, round(p_retailprice, 2) AS price, round((round(p_retailprice, 2) + round(p_retailprice, 2) + 10) / 2, 2) AS middle FROM part")
def parse_price_query(spark: SparkSession, d: str) -> DataFrame:
    cents = F.format_number(F.round("p_retailprice", 2), 2)
    low, high = F.concat(F.lit("$"), cents), F.format_number(F.round("p_retailprice", 2) + 10, 2)
    return read_table(spark, d, "part").select("p_partkey", parse_price(low).alias("price"), parse_price(F.concat(low, F.lit(" - $"), high)).alias("middle"))


@query("model_tokens", r"SELECT p_partkey, concat('BR', lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0'), upper(left(p_type, 1))) AS model, concat('BR', lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0')) AS core FROM part")
def model_tokens_query(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("BR"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.upper(F.left("p_type", F.lit(1))))
    title = F.concat("p_name", F.lit(" ("), F.lower(code), F.lit(") HEPA13 B0ABCD1234"))
    return read_table(spark, d, "part").select("p_partkey", model_tokens(title)[0].alias("model")).withColumn("core", core_model(F.col("model")))


@query("unit_conversion", "SELECT p_partkey, round(CAST(p_size AS DOUBLE) / 32, 2) AS quarts, CAST(p_size * 10 + 100 AS DOUBLE) AS watts FROM part")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.rules import capacity_qt, wattage_w

    none = F.lit(None).cast("string")
    size, watts = F.concat(F.col("p_size").cast("string"), F.lit(" fl oz")), F.concat((F.col("p_size") * 10 + 100).cast("string"), F.lit(" watts"))
    return read_table(spark, d, "part").select("p_partkey", capacity_qt(size, none)["value"].alias("quarts"), wattage_w(none, watts)["value"].alias("watts"))


@query("product_type_rules", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'blender' WHEN 1 THEN 'accessory/part' WHEN 2 THEN 'bundle' ELSE 'unclassified' END AS type FROM part")
def product_type_rules(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ["blender", "filter 18355", "blender + mixer", "thing"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    return read_table(spark, d, "part").select("p_partkey", product_type(none, F.concat(F.lit("xx "), tail))["type"].alias("type"))


@query("base_model_sibling", """WITH m AS (SELECT p_partkey, concat('AB', lpad(CAST(p_partkey // 3 % 500 AS VARCHAR), 3, '0'), CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'BK' ELSE 'WM' END) AS model FROM part),
s AS (SELECT *, CASE WHEN model LIKE '%BK' OR model LIKE '%WM' THEN left(model, length(model) - 2) ELSE model END AS stripped FROM m)
SELECT p_partkey, model, CASE WHEN stripped <> model AND n > 1 THEN stripped ELSE model END AS base_model FROM (SELECT s.*, c.n FROM s JOIN (SELECT stripped, count(DISTINCT model) AS n FROM s GROUP BY 1) c USING (stripped))""")
def base_model_sibling(spark: SparkSession, d: str) -> DataFrame:
    """A suffix is stripped only where a sibling shares the base: one aggregate of the stripped codes, joined back."""
    from ..fixed import MODEL_SUFFIX

    suffix = F.element_at(F.array(F.lit(""), F.lit("BK"), F.lit("WM")), (F.col("p_partkey") % 3 + 1).cast("int"))
    code = F.concat(F.lit("AB"), F.lpad((F.floor(F.col("p_partkey") / 3) % 500).cast("string"), 3, "0"), suffix)
    m = read_table(spark, d, "part").select("p_partkey", code.alias("model")).withColumn("stripped", F.regexp_replace("model", MODEL_SUFFIX, ""))
    n = m.groupBy("stripped").agg(F.countDistinct("model").alias("n"))
    base = F.when((F.col("stripped") != F.col("model")) & (F.length("stripped") >= 4) & (F.col("n") > 1), F.col("stripped")).otherwise(F.col("model"))
    return m.join(n, "stripped").select("p_partkey", "model", base.alias("base_model"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records of the matcher: title, model code, price, brand and block."""
    model = F.concat(F.lower(F.left("p_type", F.lit(2))), F.lpad((F.col("p_size") * 7).cast("string"), 3, "0"))
    rows = read_table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), norm_text(F.col("p_name")).alias("title_norm"), F.when(F.col("p_size") % 2 == 0, model).alias("model_no"),
        F.when(F.col("p_size") % 5 == 0, F.array(model)).otherwise(F.array().cast("array<string>")).alias("title_model_tokens"), F.col("p_retailprice").alias("price"), F.lower("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    return rows.withColumns({"tokens": title_tokens(F.col("title_norm")), "numbers": title_numbers(F.col("title_norm"))})


#: Score from which two records are one product.
SAME_FROM = 0.58
#: What a side of a pair brings to the score.
SIDE = ("title_norm", "model_no", "title_model_tokens", "price", "brand", "tokens", "numbers")
#: Features of a pair that its types decide.
FEATURES = ("jac", "relation", "strict", "cross", "apart", "same")


def records(rows: DataFrame) -> DataFrame:
    """Listings as the records that ``operators.matching`` matches inside brand and type."""
    return rows.select("id", F.to_json(F.struct("brand", "kind")).alias("block"), F.struct(*SIDE).alias("r"), F.lit(False).alias("exact"))


def pair_score(price: Column | None = None) -> Column:
    """struct(score, reason) of the columns FEATURES and a similarity of prices; null if unknown, or where only the reason is asked for."""
    return score_features({k: F.col(k) for k in FEATURES} | {"price": F.lit(None).cast("double") if price is None else price})


def block_pairs(rows: DataFrame, **how) -> DataFrame:
    """All pairs of types of listings inside a block of brand and type (see ``operators.typed_pairs``)."""
    return type_pairs(rows, ["brand", "kind"], **how)


PAIR_SQL = """WITH l AS (SELECT p_partkey AS id, lower(p_name) AS title, CASE WHEN p_size % 2 = 0 THEN concat(lower(left(p_type, 2)), lpad(CAST(p_size * 7 AS VARCHAR), 3, '0')) END AS model,
  CASE WHEN p_size % 5 = 0 THEN [concat(lower(left(p_type, 2)), lpad(CAST(p_size * 7 AS VARCHAR), 3, '0'))] ELSE CAST([] AS VARCHAR[]) END AS tok, p_retailprice AS price, lower(p_brand) AS brand, p_type AS kind FROM part),
w AS (SELECT *, list_distinct(list_filter(string_split(title, ' '), lambda t: length(t) > 1 AND t NOT IN ('black', 'white', 'silver', 'gray', 'grey', 'red', 'blue', 'pink', 'teal', 'charcoal', 'stainless', 'steel', 'plus', 'new', 'pack', 'with', 'and', 'for', 'the'))) AS words FROM l),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.price AS pa, b.price AS pb, a.model AS ma, b.model AS mb, a.tok AS ka, b.tok AS kb, a.title = b.title AS same_title,
  CASE WHEN len(a.words) > 0 AND len(b.words) > 0 THEN len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) ELSE 0 END AS jac
  FROM w a JOIN w b ON a.brand = b.brand AND a.kind = b.kind AND a.id < b.id),
r AS (SELECT *, CASE WHEN ma IS NULL OR mb IS NULL THEN 'missing' WHEN ma = mb THEN 'equal' ELSE 'conflict' END AS rel, coalesce(list_contains(kb, ma), false) OR coalesce(list_contains(ka, mb), false) AS strict FROM p),
s AS (SELECT *, CASE WHEN rel = 'equal' THEN 1.0 WHEN rel = 'conflict' THEN CASE WHEN strict THEN 0.9 ELSE 0.0 END
  ELSE (jac + 0.35 * CAST(strict OR list_has_any(ka, kb) AS INT) + 0.1 + 0.25 * least(pa, pb) / greatest(pa, pb)) / 1.7 END AS score,
  CASE WHEN rel = 'equal' THEN 'model_equal' WHEN rel = 'conflict' THEN CASE WHEN strict THEN 'model_in_other_title' ELSE 'model_conflict' END ELSE 'blended' END AS reason FROM r)
"""


@query("title_jaccard_pairs", PAIR_SQL + "SELECT left_id, right_id, round(jac, 6) AS jac FROM p WHERE jac > 0")
def title_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = block_pairs(listings(spark, d)).filter("jac > 0").select(F.round("jac", 6).alias("jac"), "x", "y")
    return each_pair(pairs).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), "jac")


@query("score_pair", PAIR_SQL + "SELECT left_id, right_id, round(score, 5) AS score, reason FROM s")
def score_pair_query(spark: SparkSession, d: str) -> DataFrame:
    pairs = block_pairs(listings(spark, d))
    pairs = each_pair(pairs.withColumn("reason", pair_score()["reason"]))
    score = F.round(pair_score(price_similarity(F.col("a.price"), F.col("b.price")))["score"], 5)
    return pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), score.alias("score"), "reason")


@query("best_match_block", PAIR_SQL + "SELECT left_id, right_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 5) DESC, right_id) AS rn FROM s WHERE score >= 0.58) WHERE rn = 1")
def best_match_block(spark: SparkSession, d: str) -> DataFrame:
    """Each listing's best of those after it, by the index of titles and models."""
    return best_after(records(listings(spark, d)), SAME_FROM).toDF("left_id", "right_id", "score")


@query("match_metrics", PAIR_SQL + ", c AS (SELECT sum(CAST(score >= 0.58 AND same_title AS INT)) AS tp, sum(CAST(score >= 0.58 AND NOT same_title AS INT)) AS fp, sum(CAST(score < 0.58 AND same_title AS INT)) AS fn, sum(CAST(score < 0.58 AND NOT same_title AS INT)) AS tn FROM s) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fp), 5) AS precision, round(tp / (tp + fn), 5) AS recall FROM c")
def match_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of pairs of types; only if prices put some of a pair of types over the score and some under it, these are made pair by pair."""
    own, price = listings(spark, d), price_similarity(F.col("a.price"), F.col("b.price"))
    least, most = price_bounds()
    said = lambda price: pair_score(price)["score"] >= SAME_FROM
    judged = lambda pairs: pairs.select("*", said(least).alias("said"), said(most).alias("most_said"), pair_count().alias("n"))
    counts = judged(block_pairs(own, once=True, items=False)).groupBy("same_title", "said", "most_said").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)  # eight rows
    rows = counts.filter("said = most_said").select("same_title", "said", "n")
    if counts.filter("said != most_said").limit(1).count():
        open_pairs = each_item(judged(block_pairs(own, once=True)).filter("said != most_said"))
        rows = rows.unionByName(open_pairs.select("same_title", said(price).alias("said"), F.lit(1).cast("long").alias("n")))
    return confusion(rows, F.col("said"), F.col("same_title"), weight=F.col("n")).select("tp", "fp", "fn", "tn", F.round("precision", 5).alias("precision"), F.round("recall", 5).alias("recall"))


@query("connected_components", PAIR_SQL + """, e AS (SELECT left_id AS a, right_id AS b FROM s WHERE reason = 'model_equal' UNION SELECT right_id, left_id FROM s WHERE reason = 'model_equal')
SELECT node, min(b) AS comp FROM (WITH RECURSIVE reach(node, b) AS (SELECT a, a FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.b = e.a) SELECT node, b FROM reach) GROUP BY 1""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Listings of a block with the same model: each is linked to the first of them, so that there is one link a listing."""
    rows = listings(spark, d).filter("model_no is not null")
    first = rows.groupBy("brand", "kind", "model_no").agg(F.min("id").alias("a"))
    return label_components(rows.join(first, ["brand", "kind", "model_no"]).filter("id != a").select("a", F.col("id").alias("b")))


@query("canonical_listing", "SELECT p_name AS title, p_partkey AS canonical_id, CAST(n AS BIGINT) AS n_listings, brands FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_name) AS n FROM part) JOIN (SELECT p_name AS nm, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1) ON nm = p_name WHERE rn = 1")
def canonical_listing(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    first = first_rows(part, ["p_name"], [F.col("p_retailprice").desc(), F.col("p_partkey")]).select(F.col("p_name").alias("title"), F.col("p_partkey").alias("canonical_id"))
    groups = part.groupBy(F.col("p_name").alias("title")).agg(F.count(F.lit(1)).alias("n_listings"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))
    return first.join(groups, "title")


@query("column_profile", "SELECT 'p_brand' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(p_brand) AS BIGINT) AS n_filled, CAST(count(DISTINCT p_brand) AS BIGINT) AS n_distinct, min(p_brand) AS least, max(p_brand) AS greatest FROM part UNION ALL SELECT 'p_name', count(*), count(p_name), count(DISTINCT p_name), min(p_name), max(p_name) FROM part UNION ALL SELECT 'p_type', count(*), count(p_type), count(DISTINCT p_type), min(p_type), max(p_type) FROM part")
def column_profile_query(spark: SparkSession, d: str) -> DataFrame:
    return column_profile(read_table(spark, d, "part").select("p_brand", "p_name", "p_type")).drop("column_type")


@query("cluster_size_quantiles", "SELECT quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, CAST(max(n) AS BIGINT) AS largest FROM (SELECT p_name, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1)")
def cluster_size_quantiles(spark: SparkSession, d: str) -> DataFrame:
    sizes = read_table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(sizes, [], "n", (0.5, 0.9, 1.0))
    return q.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].cast("long").alias("largest"))


@query("common_tokens", "SELECT p_brand AS brand, t AS token FROM (SELECT p_brand, t, count(DISTINCT p_type) AS k FROM (SELECT p_brand, p_type, unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY 1, 2) WHERE k = 6")
def common_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a brand's titles that occur in all six types: counted by token, so no group is gathered."""
    rows = read_table(spark, d, "part").select("p_brand", "p_type", F.explode(F.split("p_name", " ")).alias("token"))
    return rows.groupBy(F.col("p_brand").alias("brand"), "token").agg(F.countDistinct("p_type").alias("k")).filter("k = 6").drop("k")


@query("quotes_top_n", "SELECT source, doc_id, CAST(n_chars AS BIGINT) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 2")
def quotes_top_n(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return first_rows(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 2)


@query("excerpt_window", r"WITH p AS (SELECT doc_id, text, CAST(instr(text, ' the ') AS INT) AS at0 FROM documents WHERE instr(text, ' the ') > 0), q AS (SELECT doc_id, text, greatest(at0 - 130, 1) AS beg FROM p) SELECT doc_id, concat(CASE WHEN beg > 1 THEN '…' ELSE '' END, trim(substr(text, beg, 260)), CASE WHEN beg + 259 < length(text) THEN '…' ELSE '' END) AS excerpt FROM q")
def excerpt_window(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").filter(F.col("text").contains(" the ")).select("doc_id", excerpt(F.col("text"), " the ").alias("excerpt"))


@query("number_tokens", r"SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", title_numbers(norm_text(F.col("props")))[0].cast("long").alias("k"))


@query("json_details", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY 1")
def json_details(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total_k"))


@query("conversation_validity", """WITH c AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, bool_and(prev IS NULL OR prev <> role) AS alternates, bool_or(back = 1 AND role = 'user') AS ends_with_user, CAST(max(length(text)) AS BIGINT) AS longest, count(*) <= 12 AND max(length(text)) <= 1000 AS within_limits FROM c GROUP BY 1""")
def conversation_validity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read_table(spark, d, "conversations").withColumns({"prev": F.lag("role").over(w), "next": F.lead("role").over(w)})
    alternates = F.bool_and(F.col("prev").isNull() | (F.col("prev") != F.col("role")))
    ends = F.bool_or(F.col("next").isNull() & (F.col("role") == "user"))
    out = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), alternates.alias("alternates"), ends.alias("ends_with_user"), F.max(F.length("text")).cast("long").alias("longest"))
    return out.withColumn("within_limits", (F.col("turns") <= 12) & (F.col("longest") <= 1000))


@query("house_style_filter")
def house_style_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", house_style(F.col("text"), r"(?i)\bas an ai\b").alias("text"))


@query("substring_search", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE contains(lower(text), 'released under the')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a phrase, through an index of trigrams."""
    path = new_folder(spark, "index")
    write_index(read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    return search(spark, path, "Released under the").select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n"))
