"""A corpus pipeline of the training-data operators over ``documents``.

Each stage gets all that the one before kept and is written as Parquet before the next
reads it.  All stages but the last return the columns of their input.  A table that is read
again has no row order, so the last stage says by slot and pos where mixing puts a document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listforge.llm import exact_dedup, langid, mixing, partenum, rank_bpe
from listforge.llm.common import fold_of, free_name, table
from listforge.session import materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: no text, no letter or a rejected score go."""
    model = langid.train(docs, fold_of(F.col("doc_id"), 4) != 2)
    found = F.col(free_name(docs, "_lang"))
    return langid.identify(docs, model).where(~found["rejected"]).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_one_of_each(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Rows without a doc_id cannot be named by a group and stay.
    """
    kept = partenum.jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources by their target weights."""
    return mixing.mixed_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded documents, with their place in the mix.

    The place is ``mixing.interleave``'s, derived again without the texts: (slot, pos) ascending
    is the order of the mixing stage.  It is joined by id and digest of the text; rows equal in
    both are numbered, since it does not matter which of them takes which place.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = rank_bpe.decode_documents(rank_bpe.encode_documents(docs, ranks, pattern), ranks, pattern)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    short = docs.select("doc_id", "source", digest.alias("digest"), F.xxhash64(F.struct(*docs.columns)).alias("hash"))
    places = mixing.interleave(short, tie=F.col("hash")).select(
        F.col("_row.doc_id").alias("id"), F.col("_row.digest").alias("digest"), "_mix.slot", "_mix.pos")
    places = places.withColumn("copy", F.row_number().over(Window.partitionBy("id", "digest").orderBy("slot", "pos")))
    tokens = tokens.withColumn("copy", F.row_number().over(
        Window.partitionBy("doc_id", "decoded_sha256").orderBy("ids_sha256")))
    same = tokens["doc_id"].eqNullSafe(places["id"]) & (tokens["decoded_sha256"] == places["digest"]) & (
        tokens["copy"] == places["copy"])
    return tokens.join(places, same, "left").select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "slot", "pos")


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct_texts),
    ("jaccard_join", distinct_shingles),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

# no SQL: a trained model, 64-bit signatures and a tokenizer are not SQL; the tests compare
# every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
