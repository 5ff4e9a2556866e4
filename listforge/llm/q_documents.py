"""Queries over ``documents``: language, duplicates, mixing, token files, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.llm import exact_dedup, langid, mixing, partenum, positional_index, rank_bpe, token_files, toxicity
from listforge.llm.common import fold_of, table


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "_lang.lang_pred", "_lang.score", "_lang.rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held_out)
    score = F.col("_toxicity")
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.interleave(docs).select("_row.doc_id", "_row.source", "_mix.block", "_mix.release",
                                          "_mix.deadline", "_mix.slot", "_mix.pos")


def op9_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = rank_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    return rank_bpe.decode_documents(encoded, ranks, pattern)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op3_language_id, op5_toxicity, op6_partenum_join, op7_token_files, op8_mixing, op9_rank_bpe, op10_exact_dedup,
    op12_positional_index)}

ORACLE = {
    "op8_mixing": """
WITH RECURSIVE n AS (
  SELECT coalesce('s' || source, 'n') AS src, count(*) AS n FROM documents GROUP BY 1),
w AS (
  SELECT src, CAST(greatest(1, round(pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM n) * 1000)) AS BIGINT) AS p
  FROM n),
src AS (SELECT src, p, row_number() OVER (ORDER BY src) AS i, sum(p) OVER () AS q FROM w),
one AS (SELECT list(p ORDER BY i) AS p, CAST(max(q) AS BIGINT) AS q FROM src),
sched AS (
  SELECT -1::BIGINT AS t, list_transform(p, lambda x: 0::BIGINT) AS done, p, q, 0::BIGINT AS i FROM one
  UNION ALL
  SELECT t, list_transform(range(1, len(p) + 1), lambda s: done[s] + CASE WHEN s = pick THEN 1 ELSE 0 END), p, q, pick
  FROM (SELECT t + 1 AS t, done, p, q,
               list_sort(list_filter(list_transform(range(1, len(p) + 1), lambda s:
                 CASE WHEN done[s] * q // p[s] <= t + 1
                      THEN {'d': ((done[s] + 1) * q + p[s] - 1) // p[s], 's': s} END),
                 lambda e: e IS NOT NULL))[1].s AS pick
        FROM sched WHERE t + 1 < q)),
plan AS (
  SELECT src.src, src.p, src.q, t AS slot, row_number() OVER (PARTITION BY sched.i ORDER BY t) - 1 AS k
  FROM sched JOIN src ON src.i = sched.i WHERE t >= 0),
placed AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS nth
  FROM documents)
SELECT doc_id, source, CAST(nth // 16 AS BIGINT) AS block,
       CAST(k * q // p + (nth // 16) // p * q AS BIGINT) AS release,
       CAST(((k + 1) * q + p - 1) // p + (nth // 16) // p * q AS BIGINT) AS deadline,
       CAST(slot + (nth // 16) // p * q AS BIGINT) AS slot, CAST(nth % 16 AS BIGINT) AS pos
FROM placed JOIN plan ON plan.src = placed.src AND plan.k = (nth // 16) % p
""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""",
    "op12_positional_index": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
grams AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT r, item_id, s, n FROM grams JOIN win USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
        FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
}
