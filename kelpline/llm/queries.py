"""The opN_ queries: each operator over its whole table, reduced to digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_two_fit import pack_documents
from .fill_in_middle import fill_in_middle, restored
from .html_tree import extract_pages
from .kd_shards import shard_documents
from .language_id import identify, train_languages
from .language_id import is_held_out as held_out_of_languages
from .ngram_join import ngram_join
from .nra_topk import top_k
from .orc_tokens import encode_and_read_back
from .positional_index import find_contamination
from .quality import is_held_out, score, train
from .secret_forest import find_secrets, train_forest
from .suffix_dedup import remove_repeats
from .weighted_kmeans import cluster_vectors
from .word_encoder import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A document is good from this score on.
GOOD_FROM = 0.3


def op1_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.withColumn("held_out", is_held_out(F.col("doc_id"))), weights, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), train_forest())


def op3_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op4_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hits", "items")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op10_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op11_weighted_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, width=64, seed=1)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20)
    size = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", size("prefix"), size("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out_of_languages(F.col("doc_id")))
    return identify(docs, train_languages(docs.filter("not held_out")), ["doc_id", "held_out"])


QUERIES = {
    "op1_ftrl_quality": op1_ftrl_quality,
    "op2_secret_forest": op2_secret_forest,
    "op3_nra_topk": op3_nra_topk,
    "op4_html_tree_scoring": op4_html_tree_scoring,
    "op5_positional_decontamination": op5_positional_decontamination,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_orc_tokens": op9_orc_tokens,
    "op10_suffix_merge_dedup": op10_suffix_merge_dedup,
    "op11_weighted_kmeans": op11_weighted_kmeans,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_naive_bayes_language": op13_naive_bayes_language,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lloyd_sql(k: int, rounds: int) -> str:
    """The clustering in SQL: a round is the assignments a0, a1, ... from the centroids c0, c1, ..."""
    whole = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [f"v AS (SELECT row_number() OVER () AS r, vec_id, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS BIGINT[]) AS q FROM embeddings WHERE {whole})"]
    parts.append(f"c0 AS (SELECT CAST(place - 1 AS INT) AS c, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) AS place FROM v) WHERE place <= {k})")
    for i in range(rounds + 1):
        far = f"list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{i} AS (SELECT * FROM (SELECT r, vec_id, v.q AS q, c, CAST({far} AS BIGINT) AS distance, row_number() OVER (PARTITION BY r ORDER BY {far}, c) AS place FROM v, c{i}) WHERE place = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(1, 65)) AS d FROM a{i}) GROUP BY 1, 2)")
            parts.append(f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS q FROM s{i} GROUP BY 1)")
            parts.append(f"c{i + 1} AS (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))")
    chosen = f"""SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""
    return "WITH " + ",\n".join(parts) + "\n" + chosen


#: SQL for DuckDB of the queries that it can express and run over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_nra_topk": """
WITH v AS (SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""",
    "op5_positional_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT dw.doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
l AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)""",
    "op11_weighted_kmeans": _lloyd_sql(16, 3),
    "op12_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || substr(h, CAST(8 * i + 1 AS INT), 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
f AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
