"""Event studies: windows around events, controls, effects, bands, multiple tests, placebos, bootstraps."""

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import EVENT_WINDOWS
from ..operators.event_study import Z95, effects, judged, low_rating_events, natural_swing, placebo_events, placed, select_controls, window_pool
from ..operators.event_study import comparison_band as bands
from ..operators.relational import benjamini_hochberg, checkpointed, few_ids, stored
from ..sources.readers import read_table, reviews
from .registry import RV, query
from .review_queries import COMPLETE

#: Months on each side of an event.
WINDOW = 6
#: Seed of random draws, placebo draws a set, repeats of a type's bootstrap and of the pooled one.
SEED, DRAWS, REPEATS, POOLED_REPEATS = 20260923, 12000, 200, 2000


def monthly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reviews by brand, type and month index."""
    index = (F.year("review_date") * 12 + F.month("review_date") - 1).cast("int").alias("mi")
    return reviews(spark, d).groupBy("brand", "product_type", index).agg(F.count(F.lit(1)).alias("n"))


def unit_span(counts: DataFrame) -> DataFrame:
    """An event a unit: the month ten after its first; units are brands in a type."""
    return counts.groupBy("brand", "product_type").agg(F.min("mi").alias("first_mi")).withColumn("m0", F.col("first_mi") + 10)


def windows(counts: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """pre and post sums of the months around m0, the event's own left out; by an equi-join on the month, not a range join."""
    grid = events.withColumn("rel", F.explode(F.sequence(F.lit(-WINDOW), F.lit(WINDOW)))).filter("rel != 0").withColumn("mi", F.col("m0") + F.col("rel"))
    rows = grid.join(counts, ["brand", "product_type", "mi"], "left").fillna(0, ["n"])
    sums = rows.groupBy(*keys).agg(F.sum(F.when(F.col("rel") < 0, F.col("n")).otherwise(0)).alias("pre"), F.sum(F.when(F.col("rel") > 0, F.col("n")).otherwise(0)).alias("post"))
    return sums.withColumn("log_change", F.round(F.log((F.col("post") + 0.5) / (F.col("pre") + 0.5)), 6))


WINDOW_SQL = RV + """, c AS (SELECT brand, product_type, year(review_date) * 12 + month(review_date) - 1 AS mi, count(*) AS n FROM rv GROUP BY 1, 2, 3),
ev AS (SELECT brand, product_type, min(mi) + 10 AS m0 FROM c GROUP BY 1, 2),
wi AS (SELECT ev.brand, ev.product_type, ev.m0, coalesce(sum(n) FILTER (WHERE mi BETWEEN m0 - 6 AND m0 - 1), 0) AS pre, coalesce(sum(n) FILTER (WHERE mi BETWEEN m0 + 1 AND m0 + 6), 0) AS post FROM ev LEFT JOIN c USING (brand, product_type) GROUP BY 1, 2, 3),
lg AS (SELECT *, round(ln((post + 0.5) / (pre + 0.5)), 6) AS log_change FROM wi)
"""


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    counts = monthly_counts(spark, d)
    return windows(counts, unit_span(counts).drop("first_mi"), ["brand", "product_type", "m0"])


@query("event_window_effect", WINDOW_SQL + "SELECT brand, product_type, CAST(m0 AS INT) AS m0, CAST(pre AS BIGINT) AS pre, CAST(post AS BIGINT) AS post, log_change FROM lg")
def event_window_effect(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(spark, d)


class Study:
    """The study's tables: units are brands, families six lines of brands, a sibling is a part of the brand, types are the two brand sets, the broad type is all.

    Tables are checkpointed when they are first asked for, so that later plans
    are short and executors may go; Spark's cleaner deletes them when the study is gone.
    """

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.directory = spark, d

    @cached_property
    def cells(self) -> DataFrame:
        """The reviews are read once; all else comes from these: the few columns that are asked of each, which hardly any grouping would make fewer."""
        month = (F.year("review_date") * 12 + F.month("review_date") - 1).alias("mi")
        rows = reviews(self.spark, self.directory).select(F.col("brand").alias("unit"), F.col("brand_set").alias("product_type"), F.col("unit_id").alias("part"), (F.col("channel") == "new").alias("new"), month, F.col("rating").cast("long").alias("stars"))
        return stored(rows.withColumn("n", F.lit(1).cast("long")))

    @cached_property
    def counts(self) -> DataFrame:
        return checkpointed(self.cells.filter("new").groupBy("unit", "mi").agg(F.sum("n").alias("n"), F.sum("stars").alias("stars")))

    @cached_property
    def units(self) -> DataFrame:
        units = self.cells.groupBy("unit", "product_type").agg(
            F.min("mi").alias("launch_mi"), F.min(F.when(F.col("new"), F.col("mi"))).alias("first_mi"), F.min(F.when(~F.col("new"), F.col("mi"))).alias("again_mi"), F.sum(F.when(F.col("new"), F.col("n")).otherwise(0)).alias("total"))
        line = F.concat(F.lit("line "), F.substring("unit", 7, 10).cast("int") % 6)
        return checkpointed(units.filter("first_mi is not null").withColumns({"family": line, "broad": F.lit("all")}))

    @cached_property
    def low(self) -> DataFrame:
        return checkpointed(low_rating_events(self.counts, LAST))

    @cached_property
    def siblings(self) -> DataFrame:
        """A row a unit and month in which parts launched: how many, and which if they are few."""
        launches = self.cells.groupBy("unit", "part").agg(F.min("mi").alias("at"))
        months = launches.groupBy("unit", "at").agg(F.count(F.lit(1)).alias("launched"), few_ids("part").alias("parts"))
        return checkpointed(months.join(self.units.select("unit", "launch_mi", "first_mi"), "unit").filter("at <> launch_mi"))

    @cached_property
    def again(self) -> DataFrame:
        return self.units.filter("again_mi is not null").select("unit", "first_mi", F.col("again_mi").alias("m0"))

    @cached_property
    def events(self) -> DataFrame:
        spans = (F.col("first_mi") <= F.col("m0") - 6) & (F.col("m0") + 6 <= LAST)
        names = F.array_sort(F.transform("parts", lambda x: x.cast("string")))
        detail = F.when(F.col("launched") < 4, F.array_join(F.transform(names, lambda x: F.concat(x, F.lit(" launched"))), "; ")).otherwise(F.concat("launched", F.lit(" siblings launched")))
        merged = self.siblings.withColumnRenamed("at", "m0")
        kind = lambda df, name, detail: df.select(F.lit(name).alias("event_type"), "unit", F.col("m0").cast("int").alias("m0"), detail.alias("detail"))
        events = kind(merged.filter(spans), "sibling_launch", detail).union(kind(self.again.filter(spans), "refurbished", F.lit("first refurbished review"))).union(kind(self.low, "low_rating", F.lit("low rating")))
        return events.withColumn("event_id", F.concat_ws("/", "event_type", "unit", "m0"))

    @cached_property
    def marks(self) -> DataFrame:
        mark = lambda df, name, at: df.select("unit", F.lit(name).alias("event_type"), F.col(at).alias("at"))
        return checkpointed(mark(self.siblings, "sibling_launch", "at").union(mark(self.again, "refurbished", "m0")).union(mark(self.low, "low_rating", "m0")).distinct())

    @cached_property
    def pool(self) -> DataFrame:
        return checkpointed(window_pool(self.counts, self.marks, LAST))

    @cached_property
    def every(self) -> DataFrame:
        """Real events and made dates of both sets, with their site: unit, kind and month, which made dates often share."""
        every = self.events.select("event_id", "unit", "event_type", "m0", F.lit("real").alias("tag"))
        for tag in ("A", "B"):
            every = every.unionByName(placebo_events(self.units, self.marks, LAST, DRAWS, tag).withColumn("tag", F.lit(tag)))
        return checkpointed(every.withColumn("site", F.concat_ws("/", "event_type", "unit", "m0")))

    @cached_property
    def placed(self) -> DataFrame:
        """The sites that have windows, each once; event_id is the site, which is a real event's own id, too."""
        sites = self.every.select(F.col("site").alias("event_id"), "unit", "event_type", "m0").distinct()
        return checkpointed(placed(sites, self.pool, self.units))

    @cached_property
    def controls(self) -> DataFrame:
        return checkpointed(select_controls(self.placed, self.pool, self.units))

    @cached_property
    def measured(self) -> DataFrame:
        window = F.when(F.col("event_type") == "low_rating", EVENT_WINDOWS["low_rating"]).otherwise(EVENT_WINDOWS["sibling_launch"])
        sites = effects(self.placed, self.controls).withColumn("event_window", window).withColumnRenamed("event_id", "site")
        return checkpointed(self.every.select("event_id", "tag", "site").join(sites, "site"))

    def of(self, tag: str) -> DataFrame:
        return self.measured.filter(F.col("tag") == tag)

    def real_sites(self, df: DataFrame) -> DataFrame:
        return df.join(self.events.select("event_id"), "event_id", "left_semi")

    @cached_property
    def swing(self) -> DataFrame:
        return checkpointed(natural_swing(self.of("A")))

    def judged(self, tags: str) -> DataFrame:
        """Events or made dates against the swing at those of set A."""
        return judged(self.measured.filter(tags), self.swing)


#: The study that was asked for last, by session and the state of its tables.
_LAST_STUDY: dict[tuple, Study] = {}


def study_of(spark: SparkSession, d: str) -> Study:
    """The study of a directory's tables, shared by all queries of a session until another one is asked for or files change."""
    jvm, files = spark.sparkContext._jvm, []
    for name in ("lineitem", "orders", "part"):
        path = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        files += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    key = (spark.sparkContext.applicationId, d, *files)
    if key not in _LAST_STUDY:
        _LAST_STUDY.clear()
        _LAST_STUDY[key] = Study(spark, d)
    return _LAST_STUDY[key]


#: The last complete month, as a number.
LAST = COMPLETE.year * 12 + COMPLETE.month - 1

STUDY_SQL = RV.replace("WITH", "WITH RECURSIVE", 1) + """, v AS (SELECT brand AS unit, unit_id AS part, brand_set, channel, rating, year(review_date) * 12 + month(review_date) - 1 AS mi FROM rv),
c AS (SELECT unit, mi, count(*) AS n, sum(rating) AS stars FROM v WHERE channel = 'new' GROUP BY 1, 2),
u AS (SELECT unit, brand_set AS product_type, concat('line ', CAST(substr(unit, 7) AS INT) % 6) AS family, min(mi) AS launch_mi, min(mi) FILTER (WHERE channel = 'new') AS first_mi, min(mi) FILTER (WHERE channel <> 'new') AS again_mi, count(*) FILTER (WHERE channel = 'new') AS total FROM v GROUP BY 1, 2, 3 HAVING first_mi IS NOT NULL),
kinds AS (SELECT * FROM (VALUES ('sibling_launch', 12), ('refurbished', 12), ('low_rating', 3)) k(event_type, w)),
days AS (SELECT unit, first_mi, unnest(range(first_mi, 24018)) AS mi FROM u),
d AS (SELECT unit, first_mi, mi, coalesce(n, 0) AS n, coalesce(stars, 0) AS stars FROM days LEFT JOIN c USING (unit, mi)),
tr AS (SELECT *, sum(n) OVER y AS tn, sum(stars) OVER y AS ts FROM d WINDOW y AS (PARTITION BY unit ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
low AS (SELECT unit, mi FROM tr WHERE mi - first_mi >= 12 AND mi <= 24014 AND n >= 10 AND tn >= 30 AND stars / n <= ts / tn - 0.3),
fired AS (SELECT unit, min(mi) AS m0 FROM low GROUP BY 1 UNION ALL SELECT f.unit, min(low.mi) FROM fired f JOIN low ON low.unit = f.unit AND low.mi >= f.m0 + 6 GROUP BY f.unit, f.m0),
la2 AS (SELECT unit, part, min(mi) AS at_mi FROM v GROUP BY 1, 2),
sib AS (SELECT la2.unit, part, at_mi, first_mi FROM la2 JOIN u USING (unit) WHERE at_mi <> launch_mi),
ev AS (SELECT 'sibling_launch' AS event_type, unit, at_mi AS m0, CASE WHEN count(*) < 4 THEN string_agg(concat(part, ' launched'), '; ' ORDER BY CAST(part AS VARCHAR)) ELSE concat(count(*), ' siblings launched') END AS detail FROM sib WHERE first_mi <= at_mi - 6 AND at_mi + 6 <= 24017 GROUP BY 2, 3
  UNION ALL SELECT 'refurbished', unit, again_mi, 'first refurbished review' FROM u WHERE first_mi <= again_mi - 6 AND again_mi + 6 <= 24017 UNION ALL SELECT 'low_rating', unit, m0, 'low rating' FROM fired),
marks AS (SELECT DISTINCT unit, 'sibling_launch' AS event_type, at_mi FROM sib UNION ALL SELECT unit, 'refurbished', again_mi FROM u WHERE again_mi IS NOT NULL UNION ALL SELECT unit, 'low_rating', m0 FROM fired),
iu AS (SELECT unit, first_mi, row_number() OVER (ORDER BY left(md5(unit), 2), unit) - 1 AS ix, count(*) OVER () AS k_units FROM u WHERE total >= 60),
draws AS (SELECT t.tag, r.k, ('0x' || left(md5(concat(t.tag, '/', r.k, '/unit')), 12))::BIGINT / 281474976710656.0::DOUBLE AS a, ('0x' || left(md5(concat(t.tag, '/', r.k, '/month')), 12))::BIGINT / 281474976710656.0::DOUBLE AS b, CASE WHEN r.k % 2 = 0 THEN 12 ELSE 3 END AS w FROM range(12000) r(k), (VALUES ('A'), ('B')) t(tag)),
pl AS (SELECT tag, k, unit, CASE WHEN w = 12 THEN 'sibling_launch' ELSE 'low_rating' END AS event_type, first_mi + w + CAST(floor(b * (24017 - w - first_mi - w + 1)) AS INT) AS m0 FROM draws JOIN iu ON ix = floor(a * k_units) WHERE first_mi + w <= 24017 - w),
al AS (SELECT concat(event_type, '/', unit, '/', m0) AS event_id, 'real' AS tag, unit, event_type, m0 FROM ev
  UNION ALL SELECT concat(tag, k), tag, unit, event_type, m0 FROM pl WHERE NOT EXISTS (SELECT 1 FROM marks m JOIN kinds USING (event_type) WHERE m.unit = pl.unit AND abs(m.at_mi - pl.m0) <= kinds.w)),
po0 AS (SELECT d.unit, event_type, w, d.mi AS m0, least(w, d.mi - d.first_mi) AS pre_months, least(w, 24017 - d.mi) AS post_months, coalesce(sum(x.n) FILTER (WHERE x.mi < d.mi), 0) AS pre, coalesce(sum(x.n) FILTER (WHERE x.mi > d.mi), 0) AS post
  FROM d CROSS JOIN kinds LEFT JOIN d x ON x.unit = d.unit AND x.mi BETWEEN d.mi - w AND d.mi + w GROUP BY ALL),
pool AS (SELECT po0.*, product_type, family, launch_mi, first_mi, ln(pre / pre_months + 0.5) AS lv, ln(post / post_months + 0.5) - ln(pre / pre_months + 0.5) AS ch, EXISTS (SELECT 1 FROM marks m WHERE m.unit = po0.unit AND m.event_type = po0.event_type AND abs(m.at_mi - po0.m0) <= po0.w) AS spoiled
  FROM po0 JOIN u USING (unit) WHERE pre_months >= greatest(2, w // 2) AND post_months >= greatest(2, w // 2)),
pe AS (SELECT event_id, tag, pool.* FROM al JOIN pool USING (unit, event_type, m0)),
ca AS (SELECT e.event_id, x.unit AS control, x.ch, x.pre AS c_pre, x.pre_months AS c_pre_months, x.first_mi AS c_first, round(abs(x.lv - e.lv), 9) AS gap, abs(x.launch_mi - e.launch_mi) AS apart, e.product_type = x.product_type AS same FROM pe e JOIN pool x USING (event_type, m0)
  WHERE x.unit <> e.unit AND x.family <> e.family AND NOT x.spoiled AND x.pre > 0 AND abs(x.first_mi - e.first_mi) <= greatest(12, 0.5 * (e.m0 - e.first_mi))),
cb AS (SELECT *, same AND apart <= 24 AND gap <= round(ln(3.0), 9) AS strict, same AND apart <= 48 AND gap <= round(ln(5.0), 9) AS relaxed, apart <= 48 AND gap <= round(ln(5.0), 9) AS broad FROM ca),
cc AS (SELECT *, CASE WHEN count(*) FILTER (WHERE strict) OVER e >= 3 THEN 'strict' WHEN count(*) FILTER (WHERE relaxed) OVER e >= 3 THEN 'relaxed' ELSE 'broad category' END AS tier FROM cb WINDOW e AS (PARTITION BY event_id)),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, control) AS place FROM cc WHERE CASE tier WHEN 'strict' THEN strict WHEN 'relaxed' THEN relaxed ELSE broad END) WHERE place <= 10),
ag AS (SELECT event_id, count(*) AS n_controls, max(tier) AS tier, avg(ch) AS d_c, var_pop(ch) AS var_c FROM ct GROUP BY 1),
pa AS (SELECT DISTINCT total, months, total::DOUBLE AS lam, total + months / 2.0::DOUBLE AS m FROM (SELECT pre AS total, pre_months AS months FROM pe UNION ALL SELECT post, post_months FROM pe)),
ks AS (SELECT total, months, exp(k * ln(lam) - lam - lgamma(k + 1)) AS q, ln((k + months / 2.0::DOUBLE) / m) AS x FROM (SELECT *, unnest(range(0, CAST(ceil(lam + 12 * sqrt(lam) + 20) AS INT) + 1)) AS k FROM pa WHERE total BETWEEN 1 AND 100)),
lv AS (SELECT total, months, sum(q * x * x) - sum(q * x) * sum(q * x) AS var FROM ks GROUP BY 1, 2 UNION ALL SELECT total, months, 0 FROM pa WHERE total = 0
  UNION ALL SELECT total, months, lam / m ** 2 - lam / m ** 3 + (2 * lam * lam + lam) / (4 * m ** 4) + 2 * (3 * lam * lam + lam) / (3 * m ** 4) FROM pa WHERE total > 100),
te AS (SELECT pe.*, coalesce(n_controls, 0) AS n_controls, coalesce(tier, 'broad category') AS tier, CASE WHEN pre >= 30 AND n_controls >= 3 THEN ch - d_c END AS log_effect, CASE WHEN pre >= 30 AND n_controls >= 3 THEN a.var + b.var + var_c / n_controls END AS boot_var
  FROM pe LEFT JOIN ag USING (event_id) JOIN lv a ON a.total = pre AND a.months = pre_months JOIN lv b ON b.total = post AND b.months = post_months),
sw AS (SELECT w, count(*) AS n_null, (quantile_cont(log_effect, 0.95) - quantile_cont(log_effect, 0.05)) / 3.29 AS swing FROM te WHERE tag = 'A' AND log_effect IS NOT NULL GROUP BY 1),
j0 AS (SELECT te.*, n_null, coalesce(swing, 0) AS swing, sqrt(boot_var + coalesce(swing, 0) ** 2) AS sd FROM te LEFT JOIN sw USING (w)),
ju AS (SELECT *, exp(log_effect) - 1 AS effect, exp(log_effect - 1.645 * sd) - 1 AS lo, exp(log_effect + 1.645 * sd) - 1 AS hi, CASE WHEN log_effect IS NULL THEN 'not_enough_data' WHEN abs(effect) >= 0.15 AND (lo > 0 OR hi < 0) THEN 'moved' ELSE 'no_clear_change' END AS verdict, post / post_months < 0.2 * pre / pre_months AND post < post_months AS near_zero_after FROM j0),
pv AS (SELECT ju.event_id, max(((SELECT count(*) FROM te z WHERE z.tag = 'A' AND z.w = ju.w AND abs(z.log_effect) >= abs(ju.log_effect)) + 1) / (n_null + 1)) AS p FROM ju WHERE tag = 'real' AND log_effect IS NOT NULL AND n_null IS NOT NULL GROUP BY 1),
pr AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER () AS m FROM pv),
fd AS (SELECT event_id, p, coalesce(p <= (SELECT max(p) FROM pr WHERE p <= k / m * 0.1), false) AS survives FROM pr)
"""


@query("event_stream", STUDY_SQL + "SELECT event_type, unit, CAST(m0 AS INT) AS m0, detail FROM ev")
def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sibling launches (merged by month), first refurbished reviews and low ratings as one table."""
    return study_of(spark, d).events.drop("event_id")


@query("control_selection_tiers", STUDY_SQL + "SELECT event_id, control, tier, round(gap, 6) AS gap, CAST(place AS INT) AS place FROM ct JOIN pe USING (event_id) WHERE tag = 'real'")
def control_selection_tiers(spark: SparkSession, d: str) -> DataFrame:
    study = study_of(spark, d)
    return study.real_sites(study.controls).select("event_id", "control", "tier", F.round("gap", 6).alias("gap"), "place")


@query("event_effects", STUDY_SQL + "SELECT event_id, CAST(n_controls AS BIGINT) AS n_controls, tier, round(effect, 5) AS effect, round(lo, 5) AS lo, round(hi, 5) AS hi, round(p, 6) AS p, coalesce(survives, false) AS survives, CASE WHEN verdict = 'moved' AND NOT coalesce(survives, false) THEN 'no_clear_change' ELSE verdict END AS verdict, near_zero_after FROM ju LEFT JOIN fd USING (event_id) WHERE tag = 'real'")
def event_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects with intervals; a move must also survive the false-discovery control over all tests."""
    rows = checkpointed(study_of(spark, d).judged("tag = 'real'"))
    kept = benjamini_hochberg(rows.filter("p is not null").select("event_id", "p"), "p", 0.1).select("event_id", "survives")
    rows = rows.join(kept, "event_id", "left").withColumn("survives", F.coalesce("survives", F.lit(False)))
    verdict = F.when((F.col("verdict") == "moved") & ~F.col("survives"), "no_clear_change").otherwise(F.col("verdict"))
    return rows.select("event_id", "n_controls", "tier", *(F.round(c, 5).alias(c) for c in ("effect", "lo", "hi")), F.round("p", 6).alias("p"), "survives", verdict.alias("verdict"), "near_zero_after")


BAND_SQL = STUDY_SQL + """, re AS (SELECT pe.event_id, pe.unit, pe.pre / pe.pre_months + 0.5 AS own_level, pe.first_mi, unnest(range(-pe.w, pe.w + 1)) AS rel, pe.m0 FROM pe WHERE tag = 'real'),
bv AS (SELECT re.event_id, rel, re.unit, first_mi, m0, coalesce(x.n, 0) * own_level / (c_pre / c_pre_months + 0.5) AS v FROM re JOIN ct ON ct.event_id = re.event_id AND m0 + rel >= c_first AND m0 + rel <= 24017 LEFT JOIN c x ON x.unit = ct.control AND x.mi = m0 + rel)
SELECT event_id, CAST(rel AS INT) AS rel, max(CASE WHEN m0 + rel >= first_mi THEN coalesce(o.n, 0) END) AS own, round(quantile_cont(v, 0.25), 5) AS lo, round(quantile_cont(v, 0.5), 5) AS mid, round(quantile_cont(v, 0.75), 5) AS hi FROM bv LEFT JOIN c o ON o.unit = bv.unit AND o.mi = m0 + rel GROUP BY 1, 2"""


@query("comparison_band", BAND_SQL)
def comparison_band(spark: SparkSession, d: str) -> DataFrame:
    study = study_of(spark, d)
    band = bands(study.real_sites(study.placed), study.controls, study.counts, study.units, LAST)
    return band.select("event_id", "rel", "own", *(F.round(c, 5).alias(c) for c in ("lo", "mid", "hi")))


P_SQL = "WITH t AS (SELECT doc_id, CAST(('0x' || left(md5(text), 6)) AS BIGINT) / 16777216.0 AS u FROM documents), p AS (SELECT doc_id, round(u * u * u, 9) AS p FROM t)\n"


def p_values(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic numbers that stand for p-values: cubes of hashes in 0 to 1."""
    u = F.conv(F.left(F.md5("text"), F.lit(6)), 16, 10).cast("long") / 16777216.0
    return read_table(spark, d, "documents").select("doc_id", F.round(u * u * u, 9).alias("p"))


@query("bh_fdr", P_SQL + ", r AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER () AS m FROM p), l AS (SELECT max(p) AS line FROM r WHERE p <= k / m * 0.1) SELECT doc_id, p, CAST(k AS BIGINT) AS p_rank, CAST(m AS BIGINT) AS p_count, coalesce(p <= line, false) AS survives FROM r, l")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    return benjamini_hochberg(p_values(spark, d), "p", 0.1).select("doc_id", "p", "p_rank", "p_count", "survives")


@query("empirical_p", STUDY_SQL + "SELECT event_id, round(p, 6) AS p FROM pv")
def empirical_p(spark: SparkSession, d: str) -> DataFrame:
    """Share of the changes at made dates, of the same window, that are as large."""
    return study_of(spark, d).judged("tag = 'real'").filter("p is not null").select("event_id", F.round("p", 6).alias("p"))


PLACEBO_SQL = STUDY_SQL + "SELECT tag, CAST(w AS INT) AS event_window, count(*) AS n, count(log_effect) AS tested, round((quantile_cont(log_effect, 0.95) - quantile_cont(log_effect, 0.05)) / 3.29, 5) AS swing, count(*) FILTER (WHERE verdict = 'moved') AS moved FROM ju WHERE tag <> 'real' GROUP BY 1, 2"


@query("placebo_draws", PLACEBO_SQL)
def placebo_draws(spark: SparkSession, d: str) -> DataFrame:
    """Made dates in two sets: A gives the natural swing, B how many of them would be called moved though nothing happened."""
    found = study_of(spark, d).judged("tag != 'real'").groupBy("tag", "event_window")
    q = F.percentile("log_effect", F.array(F.lit(0.05), F.lit(0.95)))
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count("log_effect").alias("tested"), q.alias("q"), F.count(F.when(F.col("verdict") == "moved", 1)).alias("moved"))
    return counts.select("tag", "event_window", "n", "tested", F.round((F.col("q")[1] - F.col("q")[0]) / (2 * Z95), 5).alias("swing"), "moved")


def uniform(*keys: str | Column) -> Column:
    """A number in 0 to 1 from the hash of ``keys``: the same however rows are partitioned."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11) / float(1 << 53)


def poisson(rate: Column, *keys: str | Column) -> Column:
    """A Poisson draw of whole mean ``rate`` from hashes: for small rates as many unit steps of exponential gaps as fit, for large ones the rounded normal."""
    u, v = uniform(F.lit("u"), *keys), uniform(F.lit("v"), *keys)
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)
    large = F.greatest(F.lit(0.0), F.floor(rate + F.sqrt(rate) * normal + 0.5).cast("double"))
    # by inversion: the first k whose cumulated probability reaches u; beyond 60 nothing is left for rates of up to 12
    steps = F.aggregate(
        F.sequence(F.lit(0), F.lit(60)),
        F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("total"), F.lit(0.0).alias("k")),
        lambda s, k: F.struct((s["p"] * rate / (k + 1)).alias("p"), (s["total"] + s["p"]).alias("total"), F.when(s["total"] + s["p"] < u, s["k"] + 1.0).otherwise(s["k"]).alias("k")),
    )["k"]
    return F.when(rate <= 12, steps).otherwise(large).cast("long")


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """5 to 95 % of the mean low share of each type over resampled counts: Poisson weights of cells stand for drawing rows."""
    cells = reviews(spark, d).groupBy("product_type", "low").agg(F.count(F.lit(1)).alias("n"))
    reps = cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))).withColumn("w", poisson(F.col("n").cast("double"), "product_type", "low", "rep"))
    means = reps.groupBy("product_type", "rep").agg((F.sum(F.col("w") * F.col("low")) / F.sum("w")).alias("m"))
    q = means.groupBy("product_type").agg(F.percentile("m", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return q.select("product_type", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def pooled(rows: DataFrame, base: DataFrame, repeats: int) -> DataFrame:
    """event_type, n_events, n_units, effect, lo, hi, verdict: the mean log effect beyond that at made dates.

    Units are resampled with all their events, by Poisson weights from hashes; the made dates' mean is drawn from the normal that its resamples tend to.
    """
    null = base.filter("tested").groupBy("event_window").agg(F.avg("log_effect").alias("base"), (F.stddev_pop("log_effect") / F.sqrt(F.count(F.lit(1)))).alias("base_sd"))
    x = rows.filter("tested").join(F.broadcast(null), "event_window")  # a row a window
    units = x.groupBy("event_type", "unit").agg(F.sum("log_effect").alias("s"), F.count(F.lit(1)).alias("n"), F.first("base").alias("base"), F.first("base_sd").alias("base_sd"))
    reps = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("w", poisson(F.lit(1.0), "event_type", "unit", "rep"))
    means = reps.groupBy("event_type", "rep").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"), F.first("base").alias("base"), F.first("base_sd").alias("base_sd"))
    u, v = uniform(F.lit("base u"), "event_type", "rep"), uniform(F.lit("base v"), "event_type", "rep")
    means = means.withColumn("diff", F.col("m") - F.col("base") - F.col("base_sd") * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v))
    spread = means.groupBy("event_type").agg(F.percentile("diff", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    mean = units.groupBy("event_type").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_units"), (F.sum("s") / F.sum("n") - F.first("base")).alias("m"))
    verdict = F.when((F.col("q")[0] > 0) | (F.col("q")[1] < 0), "moved").otherwise("no_clear_change")
    return mean.join(spread, "event_type").select("event_type", "n_events", "n_units", (F.exp("m") - 1).alias("effect"), (F.exp(F.col("q")[0]) - 1).alias("lo"), (F.exp(F.col("q")[1]) - 1).alias("hi"), verdict.alias("verdict"))


@query("pooled_effect")
def pooled_effect(spark: SparkSession, d: str) -> DataFrame:
    study = study_of(spark, d)
    return pooled(study.of("real"), study.of("A"), POOLED_REPEATS)


@query("spearman_ranks", WINDOW_SQL + ", r AS (SELECT product_type, (rank() OVER (PARTITION BY product_type ORDER BY pre) + count(*) OVER (PARTITION BY product_type, pre) / 2.0 - 0.5) AS a, (rank() OVER (PARTITION BY product_type ORDER BY post) + count(*) OVER (PARTITION BY product_type, post) / 2.0 - 0.5) AS b FROM wi) SELECT product_type, round(corr(a, b), 5) AS rho FROM r GROUP BY 1")
def spearman_ranks(spark: SparkSession, d: str) -> DataFrame:
    def average_rank(c: str):
        return F.rank().over(Window.partitionBy("product_type").orderBy(c)) + F.count(F.lit(1)).over(Window.partitionBy("product_type", c)) / 2.0 - 0.5

    rows = event_windows(spark, d).select("product_type", average_rank("pre").alias("a"), average_rank("post").alias("b"))
    return rows.groupBy("product_type").agg(F.round(F.corr("a", "b"), 5).alias("rho"))
