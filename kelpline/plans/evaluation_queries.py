"""Evaluation: the matcher tuned and tested on splits, labelled pairs, diagnostics of pairs, theme precision, profiles, raw lines."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import ID_SHAPE, PAIR_WEIGHTS, TUNING_GRID, TUNING_THRESHOLDS, WEAK_PRECISION
from ..functions.dates import month_of_name
from ..functions.rules import complaint_headline, display_type, price_similarity, score_features
from ..functions.text import escaped, short_hash
from ..operators.event_study import hashed
from ..operators.pair_counts import pair_counts
from ..operators.quantiles import exact_quantiles
from ..operators.relational import checkpointed, first_rows, unpivoted
from ..operators.typed_pairs import pair_count
from ..sources.readers import lines_of, read_table
from .registry import query
from .text_queries import FLAGS_SQL, NAMES, PAIR_SQL, SAME_FROM, block_pairs, flagged, listings, pair_score

FEATURES = ["jac", "relation", "strict", "cross", "apart", "price", "same"]
WEIGHTS = list(TUNING_GRID)
#: Labelled rows a theme whose precision is measured, and repeats of its bootstrap.
SAMPLE, REPEATS = 25, 2000


def features(spark: SparkSession, d: str, grid: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Counts ``n`` of the pairs of a block by their features, label (the same title) and split: a fifth by hash is the test."""
    return pair_counts(listings(spark, d), ["brand", "kind"], 0.2, grid=grid).withColumnRenamed("drawn", "test")


FEATURE_SQL = PAIR_SQL + """, f AS (SELECT left_id, right_id, same_title AS label, jac, rel AS relation, strict, CAST(strict OR list_has_any(ka, kb) AS INT)::DOUBLE AS crossed, least(pa, pb) / greatest(pa, pb) AS price, reason, score,
  ('0x' || left(md5(concat(left_id, '/', right_id)), 12))::BIGINT / 281474976710656.0::DOUBLE < 0.2 AS test FROM s)
"""


def passed(score: Column, low: int, high: int, step: int) -> Column:
    """How many thresholds, in hundredths, the score reaches."""
    return F.greatest(F.lit(0), F.least(F.lit((high - low) // step + 1), F.floor((F.round(F.round(score, 9) * 100, 7) - low) / step) + 1)).cast("int")


def swept(counts: DataFrame, keys: list[str], thresholds: tuple[int, int, int]) -> DataFrame:
    """keys, threshold, tp, fp, fn, precision, recall, f1 of ``counts``: keys, k (thresholds reached), pos, neg.

    Counts by score come first, so the work is that of keys and thresholds, whatever the number of pairs. Thresholds that nothing reaches are left out.
    """
    low, _, step = thresholds
    every = counts.groupBy(*keys, "k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = counts.agg(F.sum("pos").alias("total")) if not keys else counts.groupBy(*keys).agg(F.sum("pos").alias("total"))
    at = every.filter("k > 0").withColumn("j", F.explode(F.sequence(F.lit(1), "k"))).groupBy(*keys, "j").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    rows = at.join(total, keys) if keys else at.join(F.broadcast(total))
    rows = rows.select(*keys, ((F.lit(low) + (F.col("j") - 1) * step) / 100).alias("threshold"), "tp", "fp", (F.col("total") - F.col("tp")).alias("fn"))
    return rated(rows)


def rated(rows: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    part = lambda below: F.round(F.coalesce(tp / F.nullif(below, F.lit(0)), F.lit(0.0)), 3)
    return rows.withColumns({"precision": part(tp + fp), "recall": part(tp + fn), "f1": F.round(F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)), 3)})


def counted(score: Column, thresholds: tuple[int, int, int]) -> list[Column]:
    return [passed(score, *thresholds).alias("k"), F.when(F.col("label"), F.col("n")).otherwise(0).alias("pos"), F.when(F.col("label"), 0).otherwise(F.col("n")).alias("neg")]


TUNE_SQL = FEATURE_SQL + """, gr AS (SELECT c.c AS w_cross, p.p AS w_price, b.b AS w_brand, n.n AS w_num FROM (VALUES (0.0::DOUBLE), (0.2), (0.35), (0.5), (0.8)) c(c), (VALUES (0.0::DOUBLE), (0.15), (0.25), (0.4)) p(p), (VALUES (0.0::DOUBLE), (0.1), (0.2)) b(b), (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3)) n(n)),
th AS (SELECT t, t / 100.0::DOUBLE AS threshold FROM range(20, 91, 2) r(t)),
fg AS (SELECT test, label, jac, relation, strict, crossed, price, count(*) AS n FROM f GROUP BY ALL),
ws AS (SELECT *, round(round(CASE WHEN relation = 'equal' THEN 1.0 WHEN relation = 'conflict' THEN CASE WHEN strict THEN 0.9 ELSE 0.0 END ELSE (1.0 * jac + w_cross * crossed + w_brand * 1 + w_price * price) / (1.0 + w_cross + w_brand + w_price) END, 9) * 100, 7) AS sc FROM fg, gr),
sc AS (SELECT w_cross, w_price, w_brand, w_num, test, label, sc, sum(n) AS n FROM ws GROUP BY ALL),
tu AS (SELECT w_cross, w_price, w_brand, w_num, threshold, test, sum(CASE WHEN label AND sc >= t THEN n ELSE 0 END) AS tp, sum(CASE WHEN NOT label AND sc >= t THEN n ELSE 0 END) AS fp, sum(CASE WHEN label AND sc < t THEN n ELSE 0 END) AS fn FROM sc, th GROUP BY ALL),
be AS (SELECT * FROM tu WHERE NOT test ORDER BY round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) DESC, w_cross, w_price, w_brand, w_num, threshold LIMIT 1),
ti AS (SELECT threshold, sum(CASE WHEN label AND round(jac, 3) * 100 >= t - 1e-7 THEN n ELSE 0 END) AS tp, sum(CASE WHEN NOT label AND round(jac, 3) * 100 >= t - 1e-7 THEN n ELSE 0 END) AS fp, sum(CASE WHEN label AND round(jac, 3) * 100 < t - 1e-7 THEN n ELSE 0 END) AS fn FROM fg, th WHERE test GROUP BY 1),
al AS (SELECT 'tuned' AS part, w_cross, w_price, w_brand, w_num, threshold, tp, fp, fn FROM be UNION ALL SELECT 'test', tu.w_cross, tu.w_price, tu.w_brand, tu.w_num, tu.threshold, tu.tp, tu.fp, tu.fn FROM tu JOIN be USING (w_cross, w_price, w_brand, w_num, threshold) WHERE tu.test
  UNION ALL SELECT 'model only', NULL, NULL, NULL, NULL, NULL, sum(CASE WHEN label AND relation = 'equal' THEN n ELSE 0 END), sum(CASE WHEN NOT label AND relation = 'equal' THEN n ELSE 0 END), sum(CASE WHEN label AND relation <> 'equal' THEN n ELSE 0 END) FROM fg WHERE test
  UNION ALL SELECT * FROM (SELECT 'title only', NULL, NULL, NULL, NULL, threshold, tp, fp, fn FROM ti ORDER BY round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) DESC, threshold LIMIT 1))
SELECT part, w_cross, w_price, w_brand, w_num, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1 FROM al"""


@query("tune_grid_f1", TUNE_SQL)
def tune_grid_f1(spark: SparkSession, d: str) -> DataFrame:
    """The 240 weights by 36 thresholds on train and validation; the best on the test split, beside the model alone and the title alone.

    Pairs with equal features count once, and prices between the same thresholds of all weights are equal, so the grid meets few rows.
    """
    low, high, step = TUNING_THRESHOLDS
    rows = checkpointed(features(spark, d, [(*cell, t / 100) for cell in itertools.product(*TUNING_GRID.values()) for t in range(low, high + 1, step)]))
    grid = F.array(*(F.struct(*(F.lit(v).alias(f"w_{k}") for k, v in zip(WEIGHTS, cell, strict=True))) for cell in itertools.product(*TUNING_GRID.values())))
    names = [f"w_{k}" for k in WEIGHTS]
    score = score_features({k: F.col(k) for k in FEATURES}, {k: F.col(f"w_{k}") for k in WEIGHTS})["score"]
    tuned = rows.filter("not test").select("*", F.inline(grid)).select(*names, *counted(score, TUNING_THRESHOLDS))
    best = swept(tuned, names, TUNING_THRESHOLDS).orderBy(F.col("f1").desc(), *names, "threshold").limit(1).select(F.lit("tuned").alias("part"), *names, "threshold", "tp", "fp", "fn")
    test = rows.filter("test")
    hit = lambda yes: [F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).alias(k) for k, c in (("tp", F.col("label") & yes), ("fp", ~F.col("label") & yes), ("fn", F.col("label") & ~yes))]
    reached = passed(score, *TUNING_THRESHOLDS) >= passed(F.col("threshold"), *TUNING_THRESHOLDS)
    on_test = test.join(F.broadcast(best.drop("part", "tp", "fp", "fn"))).groupBy(F.lit("test").alias("part"), *names, "threshold").agg(*hit(reached))  # a row of weights
    none = [F.lit(None).cast("double").alias(n) for n in names]
    model = test.agg(*hit(F.col("relation") == "equal")).select(F.lit("model only").alias("part"), *none, F.lit(None).cast("double").alias("threshold"), "tp", "fp", "fn")
    title = swept(test.select(*counted(F.round("jac", 3), TUNING_THRESHOLDS)), [], TUNING_THRESHOLDS).orderBy(F.col("f1").desc(), "threshold").limit(1)
    title = title.select(F.lit("title only").alias("part"), *none, "threshold", "tp", "fp", "fn")
    return rated(best.union(on_test).union(model).union(title)).drop("w_jac")


@query("title_threshold_sweep", FEATURE_SQL + """, th AS (SELECT t, t / 100.0::DOUBLE AS threshold FROM range(1, 100) r(t)),
sw AS (SELECT threshold, test, sum(CAST(label AND round(round(jac, 9) * 100, 7) >= t AS INT)) AS tp, sum(CAST(NOT label AND round(round(jac, 9) * 100, 7) >= t AS INT)) AS fp, sum(CAST(label AND round(round(jac, 9) * 100, 7) < t AS INT)) AS fn FROM f, th GROUP BY 1, 2)
SELECT CASE WHEN test THEN 'test' ELSE 'tune' END AS part, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1 FROM sw WHERE tp + fp > 0""")
def title_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).groupBy("test", "label", "jac").agg(F.sum("n").alias("n"))
    part = F.when(F.col("test"), "test").otherwise("tune").alias("part")
    return swept(rows.select(part, *counted(F.col("jac"), (1, 99, 1))), ["part"], (1, 99, 1))


QS = (0, 10, 25, 50, 75, 90, 100)


def gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """gap, n: relative price gaps of all pairs of ``rows`` with the same keys, counted by their distinct prices; null for prices unknown or not above 0."""
    price = F.when(F.col("price") > 0, F.col("price")).otherwise(0.0)
    at = checkpointed(rows.groupBy(*keys, price.alias("p")).agg(F.count(F.lit(1)).alias("k")))
    pairs = at.join(at.select(*keys, F.col("p").alias("q"), F.col("k").alias("m")), keys).filter("p <= q")
    n = F.when(F.col("p") == F.col("q"), F.col("k") * (F.col("k") - 1) / 2).otherwise(F.col("k") * F.col("m")).cast("long")
    return pairs.select((1 - price_similarity(F.col("p"), F.col("q"))).alias("gap"), n.alias("n")).filter("n > 0").groupBy("gap").agg(F.sum("n").alias("n"))


@query("pair_diagnostics", FEATURE_SQL + "SELECT label, CAST(count(*) AS BIGINT) AS n, round(100 * avg(CAST(relation = 'missing' AS INT)), 2) AS pct_either_missing, round(100 * avg(CAST(relation = 'equal' AS INT)), 2) AS pct_equal, round(100 * avg(CAST(relation = 'equal' AS INT)) FILTER (WHERE relation <> 'missing'), 2) AS pct_equal_of_both, round(100 * avg(crossed), 2) AS pct_cross, "
       + ", ".join(f"round(quantile_cont(jac::DOUBLE, {q / 100}), 4) AS jac_p{q}, round(quantile_cont(1 - price, {q / 100}), 4) AS gap_p{q}" for q in QS) + ", round(100 * avg(CAST(round(1 - price, 9) <= 0.05 AS INT)), 2) AS pct_within_5, round(100 * avg(CAST(round(1 - price, 9) <= 0.1 AS INT)), 2) AS pct_within_10 FROM f GROUP BY 1")
def pair_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """By label: agreement of models, quantiles of title similarity and of the relative price gap."""
    own = listings(spark, d)
    models = checkpointed(block_pairs(own, once=True, items=False).withColumn("n", pair_count()).filter("n > 0").groupBy(F.col("same_title").alias("label"), "relation", "cross", "jac").agg(F.sum("n").alias("n")))
    every, alike = gaps(own, ["brand", "kind"]), gaps(own, ["brand", "kind", "title_norm"])
    both = every.withColumn("label", F.lit(False)).unionByName(alike.withColumn("label", F.lit(True))).unionByName(alike.select("gap", (-F.col("n")).alias("n"), F.lit(False).alias("label")))
    prices = checkpointed(both.groupBy("label", "gap").agg(F.sum("n").alias("n")).filter("n > 0"))
    part = lambda yes, of=F.lit(True): F.round(100 * F.sum(F.when(yes & of, F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(of, F.col("n")).otherwise(0)), F.lit(0)), 2)
    equal, gap, n = F.col("relation") == "equal", F.round("gap", 9), F.sum("n").alias("n")
    out = models.groupBy("label").agg(n, part(F.col("relation") == "missing").alias("pct_either_missing"), part(equal).alias("pct_equal"), part(equal, F.col("relation") != "missing").alias("pct_equal_of_both"), part(F.col("cross") == 1).alias("pct_cross"))
    known = F.col("gap").isNotNull()
    out = out.join(prices.groupBy("label").agg(part(gap <= 0.05, known).alias("pct_within_5"), part(gap <= 0.1, known).alias("pct_within_10")), "label")
    cells = models.select("label", F.lit("jac").alias("name"), F.col("jac").alias("value"), "n").unionByName(prices.select("label", F.lit("gap").alias("name"), F.col("gap").alias("value"), "n"))
    q = exact_quantiles(cells, ["label", "name"], "value", [q / 100 for q in QS], F.col("n"))
    q = checkpointed(q)  # two rows a label
    for n in ("jac", "gap"):
        own = q.filter(F.col("name") == n).select("label", *(F.round(F.col("q")[k], 4).alias(f"{n}_p{p}") for k, p in enumerate(QS)))
        out = out.join(own, "label", "left")
    return out


@query("hard_pairs", FEATURE_SQL + """, h AS (SELECT *, CASE WHEN label AND jac < 0.3 AND relation <> 'equal' THEN 'matched, unlike' WHEN NOT label AND (relation = 'equal' OR jac > 0.6) THEN 'not matched, alike' END AS kind FROM f)
SELECT kind, left_id, right_id, round(jac, 3) AS jac, relation FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY left_id, right_id) AS rn FROM h WHERE kind IS NOT NULL) WHERE rn <= 10""")
def hard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first ten pairs of each kind that titles and models get wrong."""
    equal = F.col("relation") == "equal"
    kind = F.when(F.col("label") & (F.col("jac") < 0.3) & ~equal, "matched, unlike").when(~F.col("label") & (equal | (F.col("jac") > 0.6)), "not matched, alike")
    pairs = block_pairs(listings(spark, d)).withColumnRenamed("same_title", "label").withColumn("kind", kind).filter("kind is not null").select("kind", "jac", "relation", "x", "y")
    # of a pair of types, ids in order: no pair but those of the first ten lefts with the ten rights after each is among the first ten
    one = pairs.select("kind", "jac", "relation", "y", F.explode(F.slice("x.items", 1, 10)).alias("a"))
    one = one.select("kind", "jac", "relation", "a", F.explode(F.slice(F.filter("y.items", lambda i: i["id"] > F.col("a.id")), 1, 10)).alias("b"))
    rows = one.select("kind", F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.round("jac", 3).alias("jac"), "relation")
    first = [rows.filter(F.col("kind") == k).orderBy("left_id", "right_id").limit(10) for k in ("matched, unlike", "not matched, alike")]
    return first[0].union(first[1])


LABELLED_SQL = FEATURE_SQL + """, lb AS (SELECT reason, score >= 0.58 AS said, CASE WHEN ('0x' || left(md5(concat(left_id, '/', right_id, '/label')), 12))::BIGINT / 281474976710656.0::DOUBLE >= 0.1 THEN label END AS truth FROM f)
"""


@query("stratified_accuracy", LABELLED_SQL + """SELECT coalesce(reason, 'pooled') AS stratum, CAST(count(truth) AS BIGINT) AS pairs, CAST(count(*) - count(truth) AS BIGINT) AS unsure, CAST(sum(CAST(truth AS INT)) AS BIGINT) AS truly_same, round(avg(CAST(said = truth AS INT)), 6) AS accuracy,
  CASE WHEN reason IS NULL THEN round(sum(CAST(said AND truth AS INT)) / nullif(sum(CAST(said AND truth IS NOT NULL AS INT)), 0), 3) END AS precision, CASE WHEN reason IS NULL THEN round(sum(CAST(said AND truth AS INT)) / nullif(sum(CAST(truth AS INT)), 0), 3) END AS recall FROM lb GROUP BY ROLLUP (reason)""")
def stratified_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Decisions against labels by stratum and pooled; labels that are unsure (null; a tenth by hash) are counted and left out."""
    rows = pair_counts(listings(spark, d), ["brand", "kind"], 0.1, "label", [(*PAIR_WEIGHTS.values(), SAME_FROM)])
    rated = pair_score(F.col("price"))
    truth = F.when(~F.col("drawn"), F.col("label"))
    rows = rows.select(rated["reason"].alias("reason"), (rated["score"] >= SAME_FROM).alias("said"), truth.alias("truth"), "n")
    of = lambda c: F.sum(F.when(c.isNotNull(), c.cast("long") * F.col("n")))
    said, pairs = F.when(F.col("truth").isNotNull(), F.col("said")), F.coalesce(F.sum(F.when(F.col("truth").isNotNull(), F.col("n"))), F.lit(0))
    pooled = lambda below: F.when(F.grouping("reason") == 1, F.round(of(F.col("said") & F.col("truth")) / F.nullif(of(below), F.lit(0)), 3))
    out = rows.rollup("reason").agg(
        pairs.alias("pairs"), (F.sum("n") - pairs).alias("unsure"), of(F.col("truth")).alias("truly_same"), F.round(of(F.col("said") == F.col("truth")) / F.nullif(pairs, F.lit(0)), 6).alias("accuracy"),
        pooled(said).alias("precision"), pooled(F.col("truth")).alias("recall"))
    return out.withColumn("stratum", F.coalesce("reason", F.lit("pooled"))).drop("reason")


THEME_SQL = FLAGS_SQL + ", u AS (" + " UNION ALL ".join(f"""SELECT '{k}' AS theme, doc_id FROM f WHERE "{k}" """ for k in NAMES) + f"""),
sa AS (SELECT * FROM (SELECT theme, quality AS hit, row_number() OVER (PARTITION BY theme ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM u JOIN labels USING (doc_id) WHERE quality IS NOT NULL) WHERE rn <= {SAMPLE}),
th AS (SELECT theme, count(*) AS n, sum(hit) AS hits FROM sa GROUP BY 1),
dr AS (SELECT theme, r.rep, sum(CAST(floor(('0x' || left(md5(concat(theme, '/', r.rep, '/', i.i)), 12))::BIGINT / 281474976710656.0::DOUBLE * n) < hits AS INT)) / max(n) AS m FROM th, range({REPEATS}) r(rep), range({SAMPLE}) i(i) WHERE i.i < n GROUP BY 1, 2)
SELECT theme, CAST(max(n) AS BIGINT) AS n, round(max(hits / n), 6) AS precision, round(quantile_cont(m, 0.05), 6) AS lo, round(quantile_cont(m, 0.95), 6) AS hi, max(hits / n) < {WEAK_PRECISION} AS weak FROM dr JOIN th USING (theme) GROUP BY 1"""


@query("theme_precision", THEME_SQL)
def theme_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision of each theme in a labelled sample of 25 documents, with a bootstrap interval; weak themes are not to be shown.

    A document labelled as good stands for a review that does report the problem.
    """
    flags = flagged(spark, d).select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("theme"), F.col(k).alias("on")) for k in NAMES)))).filter("on")
    labels = read_table(spark, d, "labels").filter("quality is not null").select("doc_id", F.col("quality").alias("hit"))
    sample = first_rows(flags.join(labels, "doc_id"), ["theme"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], SAMPLE)
    themes = sample.groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    reps = themes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    drawn = F.aggregate(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(0), lambda s, i: s + (F.floor(hashed(F.col("theme"), F.col("rep"), i) * F.col("n")) < F.col("hits")).cast("int"))
    q = F.percentile("m", F.array(F.lit(0.05), F.lit(0.95)))
    out = reps.withColumn("m", drawn / F.col("n")).groupBy("theme", "n", "hits").agg(q.alias("q"))
    return out.select("theme", "n", F.round(F.col("hits") / F.col("n"), 6).alias("precision"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"), (F.col("hits") / F.col("n") < WEAK_PRECISION).alias("weak"))


@query("shown_themes", THEME_SQL.replace("SELECT theme, CAST(max(n)", ", pr AS (SELECT theme, CAST(max(n)", 1) + ") SELECT u.theme, CAST(count(*) AS BIGINT) AS documents FROM u LEFT JOIN pr USING (theme) WHERE NOT coalesce(weak, false) GROUP BY 1")
def shown_themes(spark: SparkSession, d: str) -> DataFrame:
    """Documents a theme, without the weak ones; a theme that was never labelled is shown."""
    counts = flagged(spark, d).select(F.inline(F.array(*(F.struct(F.lit(k).alias("theme"), F.col(k).alias("on")) for k in NAMES)))).filter("on").groupBy("theme").agg(F.count(F.lit(1)).alias("documents"))
    return counts.join(theme_precision(spark, d).filter("weak"), "theme", "left_anti")


def profile_examples(df: DataFrame, order: str) -> DataFrame:
    """column_name, kind, n_rows, n_filled, n_distinct, examples: the first three distinct values by ``order``; blank texts aren't filled.

    Values are counted by column and value, so no column's values gather in one task.
    """
    cols, kinds = [c for c in df.columns if c != order], dict(df.dtypes)
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.col(c).cast("string").alias("value")) for c in cols)))
    values = df.select(F.col(order).alias("_at"), cells).groupBy("column_name", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("at"))
    filled = F.coalesce(~F.lower(F.trim("value")).isin("", "nan", "none", "null"), F.lit(False))
    totals = values.groupBy("column_name", "kind").agg(F.sum("n").alias("n_rows"), F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("n_filled"), F.count(F.when(filled, 1)).alias("n_distinct"))
    first = first_rows(values.filter(filled), ["column_name"], [F.col("at"), F.col("value")], 3)
    shown = first.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), " | ").alias("examples"))
    return totals.join(shown, "column_name", "left")


PROFILED = ("p_brand", "p_name", "p_type", "p_size")


@query("snapshot_profile", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, p_partkey AS at_row FROM part" for c in PROFILED) + """),
g AS (SELECT column_name, value, min(at_row) AS first_row FROM v WHERE lower(trim(value)) NOT IN ('', 'nan', 'none', 'null') GROUP BY 1, 2), e AS (SELECT column_name, string_agg(value, ' | ' ORDER BY first_row, value) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY first_row, value) AS rn FROM g) WHERE rn <= 3 GROUP BY 1)
SELECT v.column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE lower(trim(value)) NOT IN ('', 'nan', 'none', 'null')) AS BIGINT) AS n_filled, CAST(count(DISTINCT value) FILTER (WHERE lower(trim(value)) NOT IN ('', 'nan', 'none', 'null')) AS BIGINT) AS n_distinct, max(examples) AS examples FROM v LEFT JOIN e USING (column_name) GROUP BY 1""")
def snapshot_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile_examples(read_table(spark, d, "part").select("p_partkey", *PROFILED), "p_partkey").drop("kind")


@query("yearly_counts", "SELECT year(o_orderdate) AS yr, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def yearly_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query("raw_line_semi_join", """SELECT concat('{"parent_asin": "', p_partkey, '", "title": "', p_name, '"}') AS value FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def raw_line_semi_join(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "part").select(F.concat(F.lit('{"parent_asin": "'), "p_partkey", F.lit('", "title": "'), "p_name", F.lit('"}')).alias("value"))
    return lines_of(lines, read_table(spark, d, "lineitem").filter("l_quantity = 50").select("l_partkey"))


@query("month_names", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", month_of_name(F.date_format("o_orderdate", "MMMM yyyy")).alias("month"))


@query("report_cells", "SELECT p_partkey, left(sha256(p_name), 16) AS visitor, concat(left(p_name, 6), CASE WHEN length(p_name) > 6 THEN '…' ELSE '' END) AS cell, p_type AS label FROM part")
def report_cells(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", short_hash(F.col("p_name")).alias("visitor"), escaped(F.col("p_name"), 6).alias("cell"), display_type(F.col("p_type")).alias("label"))


@query("complaint_headlines", FLAGS_SQL + """, s AS (SELECT lang, avg(CAST("the" AS INT)) AS own FROM f GROUP BY 1), a AS (SELECT avg(CAST("the" AS INT)) AS peers FROM f)
SELECT lang, CASE WHEN own > 0 THEN concat('the leads complaints', CASE WHEN own / peers >= 1.3 THEN concat(', ', printf('%.1f', own / peers), 'x the peer rate') WHEN own / peers <= 0.77 THEN ', below the peer rate' ELSE ', close to the peer rate' END) ELSE 'Owners report a spread of complaints, none dominant' END AS headline FROM s, a""")
def complaint_headlines(spark: SparkSession, d: str) -> DataFrame:
    rows = flagged(spark, d)
    peers = rows.agg(F.avg(F.col("the").cast("int")).alias("peers"))
    own = rows.groupBy("lang").agg(F.avg(F.col("the").cast("int")).alias("own")).join(F.broadcast(peers))  # a row
    return own.select("lang", complaint_headline(F.lit("the"), F.col("own"), F.col("peers")).alias("headline"))


def report_lines(metrics: DataFrame, title: str) -> DataFrame:
    """Markdown lines (column ``value``) of metrics (name, value) in name order, for the sinks' line writer."""
    order = Window.orderBy("name")  # a report's metrics, few
    lines = metrics.select((F.row_number().over(order) + 1).alias("at"), F.concat(F.lit("- "), "name", F.lit(": "), F.col("value").cast("string")).alias("value"))
    head = metrics.sparkSession.createDataFrame([(0, f"# {title}"), (1, "")], "at int, value string")
    return head.union(lines).orderBy("at").select("value")


def large_clusters(rows: DataFrame, cluster: str, order: str, title: str, clusters: int = 5, titles: int = 8) -> DataFrame:
    """cluster, n, titles (the first by ``order``) and tokens that all its titles hold, of the largest clusters.

    Tokens are counted by cluster, so no cluster is gathered; the largest, ``clusters`` of them, are joined by broadcast.
    """
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), cluster).limit(clusters)
    kept = rows.join(F.broadcast(sizes), cluster)  # a few rows
    first = first_rows(kept, [cluster], [F.col(order)], titles).groupBy(cluster, "n")
    shown = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, title))), lambda x: x[title]), " | ").alias("titles"))
    tokens = kept.select(cluster, "n", order, F.explode(F.array_distinct(F.split(F.lower(title), " "))).alias("token"))
    stable = tokens.groupBy(cluster, "n", "token").agg(F.count(F.lit(1)).alias("k")).filter("k = n").groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("stable"))
    return shown.join(stable, cluster, "left").withColumn("stable", F.coalesce("stable", F.lit("")))


@query("large_clusters", """WITH c AS (SELECT concat(p_type, '/', split_part(p_name, ' ', 2)) AS cluster, p_partkey, p_name FROM part), s AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, cluster LIMIT 5),
f AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p_partkey) AS rn FROM c JOIN s USING (cluster)), t AS (SELECT cluster, n, token, count(*) AS k FROM (SELECT DISTINCT cluster, n, p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM f) GROUP BY 1, 2, 3)
SELECT cluster, CAST(n AS BIGINT) AS n, string_agg(p_name, ' | ' ORDER BY p_partkey) FILTER (WHERE rn <= 8) AS titles, coalesce((SELECT string_agg(token, ' ' ORDER BY token) FROM t WHERE t.cluster = f.cluster AND k = t.n), '') AS stable FROM f GROUP BY 1, 2""")
def large_clusters_query(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").select(F.concat("p_type", F.lit("/"), F.split("p_name", " ")[1]).alias("cluster"), "p_partkey", "p_name")
    return large_clusters(rows, "cluster", "p_partkey", "p_name")


def id_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """By column: rows, values of the shape of a listing's id, plain numbers, and whether all are a row index: each number from the least to the greatest once."""
    text = lambda c: F.col(c).cast("string")
    number = lambda c: F.when(text(c).rlike(r"^[0-9]{1,18}$"), text(c).cast("long"))
    counts = lambda i, c: [F.count(c).alias(f"n{i}"), F.count(F.when(text(c).rlike(ID_SHAPE), 1)).alias(f"s{i}"), F.count(number(c)).alias(f"d{i}"), F.countDistinct(number(c)).alias(f"u{i}"), (F.max(number(c)) - F.min(number(c)) + 1).alias(f"w{i}")]
    one = df.agg(*(a for i, c in enumerate(columns) for a in counts(i, c)))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("n_listing_ids"), F.col(f"d{i}").alias("n_numbers"), F.coalesce((F.col(f"d{i}") == F.col(f"n{i}")) & (F.col(f"u{i}") == F.col(f"n{i}")) & (F.col(f"w{i}") == F.col(f"n{i}")), F.lit(False)).alias("is_row_index")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def _shape_sql(name: str, value: str) -> str:
    return f"SELECT '{name}' AS column_name, CAST(count(v) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE regexp_matches(v, '^B0[A-Z0-9]{{8}}$')) AS BIGINT) AS n_listing_ids, CAST(count(*) FILTER (WHERE regexp_matches(v, '^[0-9]{{1,18}}$')) AS BIGINT) AS n_numbers, count(v) = count(TRY_CAST(v AS BIGINT)) AND count(DISTINCT TRY_CAST(v AS BIGINT)) = count(v) AND coalesce(max(TRY_CAST(v AS BIGINT)) - min(TRY_CAST(v AS BIGINT)) + 1 = count(v), false) AS is_row_index FROM (SELECT CAST({value} AS VARCHAR) AS v FROM part)"


LISTING_ID = "CASE WHEN p_size % 3 = 0 THEN concat('B0', lpad(upper(hex(p_partkey)), 8, '0')) ELSE p_name END"


@query("id_shapes", " UNION ALL ".join(_shape_sql(n, v) for n, v in (("p_partkey", "p_partkey"), ("p_size", "p_size"), ("listing", LISTING_ID))))
def id_shapes_query(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").withColumn("listing", F.expr(LISTING_ID))
    return id_shapes(rows, ["p_partkey", "p_size", "listing"])


#: Tables of the snapshot: key figures by name (an aggregate that both engines read alike), order and columns of the sample.
SNAPSHOT = {
    "documents": ({"languages": "count(DISTINCT lang)", "characters": "sum(n_chars)", "longest": "max(n_chars)"}, "doc_id", ("doc_id", "lang", "source", "n_chars")),
    "orders": ({"customers": "count(DISTINCT o_custkey)", "open": "sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)"}, "o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus")),
    "part": ({"brands": "count(DISTINCT p_brand)", "titles": "count(DISTINCT p_name)"}, "p_partkey", ("p_partkey", "p_name", "p_brand", "p_type")),
}


@query("snapshot_key_figures", " UNION ALL ".join(f"SELECT '{t}' AS dataset, '{k}' AS figure, CAST({a} AS BIGINT) AS value FROM {t}" for t, (figures, *_) in SNAPSHOT.items() for k, a in {"rows": "count(*)", **figures}.items()))
def snapshot_key_figures(spark: SparkSession, d: str) -> DataFrame:
    """Rows and key figures of each table, one scan a table."""
    out = None
    for name, (figures, *_) in SNAPSHOT.items():
        every = {"rows": "count(*)", **figures}
        one = read_table(spark, d, name).agg(*(F.expr(a).cast("long").alias(k) for k, a in every.items())).withColumn("dataset", F.lit(name))
        rows = unpivoted(one, ["dataset"], list(every), "figure", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snapshot_samples", " UNION ALL ".join(f"SELECT '{t}' AS dataset, CAST(place AS INT) AS place, line FROM (SELECT row_number() OVER (ORDER BY {order}) AS place, concat_ws(' | ', {', '.join(columns)}) AS line FROM {t}) WHERE place <= 5" for t, (_, order, columns) in SNAPSHOT.items()))
def snapshot_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first five rows of each table as a line."""
    out = None
    for name, (_, order, columns) in SNAPSHOT.items():
        first = read_table(spark, d, name).select(*columns).orderBy(order).limit(5)
        place = F.row_number().over(Window.orderBy(order))  # five rows
        rows = first.select(F.lit(name).alias("dataset"), place.alias("place"), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out
