"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, langid, masked_lm, mixing, ngram_join, pivot_topk, token_files, toxicity, url_filter
from .common import table

#: host, path, action
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1 over all documents; learned from those that are not held out. Repeated rows each give one; no rows, none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = langid.identify(docs)
    return got.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), F.col("_lid.lang").alias("lang_pred"), F.col("_lid.score").alias("score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2 over all pages with the five rules; see :func:`url_filter.judge` for nulls and ties."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return got.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


OP2_SQL = """
WITH r(rule, host, path, action) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT row_number() OVER () AS n, page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT q.n, arg_max(r.rule, 100000 * length(r.rule) + length(r.host)) AS rule, arg_max(r.action, 100000 * length(r.rule) + length(r.host)) AS action FROM q JOIN r
  ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY q.n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM q LEFT JOIN m USING (n)
"""


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3 over all documents, a row each; a null or blank text has no token, the sum 0 and a null mean."""
    got = masked_lm.word_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    mean = F.when(F.col("_pll.n_tokens") > 0, F.col("_pll.sum_logprob") / F.col("_pll.n_tokens"))
    return got.select("doc_id", "_pll.n_tokens", "_pll.sum_logprob", mean.alias("mean_logprob"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4 over all vectors; see :func:`embedding_dedup.near_components` for nulls and repeated ids."""
    return embedding_dedup.near_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.95)


OP4_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT r, vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM g a JOIN g b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
w AS (SELECT r AS a, r AS b, vec_id AS other FROM v UNION SELECT w.a, l.b, l.other FROM w JOIN l ON w.b = l.a),
c AS (SELECT a, min(other) AS component_id FROM w GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5 over all documents; learned from labels that are not held out. Null and blank texts are scored too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.detect(docs, table(spark, sf_dir, "labels"))
    return got.select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), F.col("_toxic").alias("score"), (F.col("_toxic") >= 0.5).cast("int").alias("predicted"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6 over all documents, a row each, repeated ones too; see :func:`mixing.mix` for nulls."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=[3, 1, 2], total=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7: rows whose id is divisible by 50 against all rows; see :func:`pivot_topk.top_k` for nulls and repeated ids."""
    got = pivot_topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0, k=5, scale=256.0)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 8 over all documents: written to files, read back. Null texts have the end id only; null ids come first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.written_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9 over all documents; see :func:`ngram_join.similarity_components` for nulls and repeated ids."""
    return ngram_join.similarity_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, num=80, den=100)


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT t.a, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.b GROUP BY t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN m ON m.a = d.r LEFT JOIN n ON n.r = d.r
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10 over all documents, a row each; a null or empty text has no ids."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_language_id, op2_url_filter, op3_masked_lm, op4_embedding_dedup, op5_toxicity, op6_source_mix, op7_exact_topk, op8_token_files, op9_ngram_jaccard, op10_bpe]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op7_exact_topk": OP7_SQL, "op9_ngram_jaccard": OP9_SQL}
