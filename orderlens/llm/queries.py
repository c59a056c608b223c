"""Registered queries of the subpackage, each the thin contract form of its operator, and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import (bwt_dedup, hard_negatives, minhash, mixing, packing, pii, pivots, quality, secret_scan, spelling, topk, toxicity,
               url_filter)
from .common import in_fold, table

#: Verdict, host, path of the listed URLs.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), packing.word_tokens)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _scored(docs: DataFrame, model, held_out) -> DataFrame:
    return (docs.select("doc_id", held_out.alias("held_out"), model.score(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return _scored(docs, model, held_out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return _scored(docs, model, held_out)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "first_at",
                        "times", "score", "secret")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc.doc_id", "source", "block", "release", "slot", "deadline", "block_offset")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.listing(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    spans = found.select("doc_id", "base", "added", pii.merged(F.col("base"), F.col("added")).alias("every"))
    count = lambda kind: F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.joined(F.col("every")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.occurrences(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(CAST(a.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP8_SQL = """
WITH rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (
  SELECT page_id, row_number() OVER () AS row, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (
  SELECT p.*, rh || rp AS rule, verdict,
         row_number() OVER (PARTITION BY row ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS n
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE n = 1
"""

OP7_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         coalesce(length(text), 0) AS size FROM documents),
t AS (SELECT source, sqrt(sum(size)) AS weight FROM d GROUP BY 1),
n AS (SELECT CAST(greatest(720, 4 * count(*)) AS BIGINT) AS cycle FROM t),
a AS (SELECT source, cycle - count(*) OVER () AS spare, (cycle - count(*) OVER ()) * weight / sum(weight) OVER () AS due FROM t, n),
b AS (SELECT *, spare - sum(floor(due)) OVER () AS extra, row_number() OVER (ORDER BY due - floor(due) DESC, source) AS r FROM a),
p AS (SELECT source, CAST(floor(due) + 1 + CASE WHEN r <= extra THEN 1 ELSE 0 END AS BIGINT) AS parts,
             row_number() OVER (ORDER BY source) AS i FROM b),
l AS (SELECT list(parts ORDER BY i) AS parts, any_value(cycle) AS cycle FROM p, n),
e AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(parts, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: x + CASE WHEN j = k THEN 1 ELSE 0 END), k FROM (
    SELECT t, done, cycle, list_min(list_transform(done, lambda x, j: CASE
      WHEN x * cycle // parts[j] <= t + 1 THEN ((x + 1) * cycle + parts[j] - 1) // parts[j] * 100000 + j
      ELSE 1000000000000000 END)) % 100000 AS k FROM e, l) WHERE t + 1 < cycle),
s AS (SELECT source, parts, t AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM e JOIN p ON i = pick WHERE t >= 0),
f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
g AS (SELECT f.*, CAST(before // 64000 AS BIGINT) AS block FROM f)
SELECT doc_id, g.source, block, block // parts * cycle + turn * cycle // parts AS release, block // parts * cycle + place AS slot,
       block // parts * cycle + ((turn + 1) * cycle + parts - 1) // parts AS deadline, CAST(before % 64000 AS BIGINT) AS block_offset
FROM g JOIN s ON s.source = g.source AND s.turn = block % parts, n
"""

QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_minhash_dedup, op4_exact_top_k, op5_secret_scan, op6_toxicity,
                                   op7_mixing, op8_url_filter, op9_embedding_dedup, op10_suffix_dedup, op11_pii, op12_spelling,
                                   op13_hard_negatives)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op4_exact_top_k": OP4_SQL, "op7_mixing": OP7_SQL, "op8_url_filter": OP8_SQL,
           "op13_hard_negatives": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
