"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Three stages, each of which compares the full normalised text (the digest only
decides where rows meet):

1. map side: Spark's partial aggregation combines equal texts of one partition;
2. salted groups: (digest, salt, text) with the salt taken from the id, so a text that
   a third of all rows share meets in ``salts`` tasks instead of one;
3. salt winners: at most ``salts`` rows of a text meet under its digest.

The verdicts then travel back on narrow rows, first to (digest, salt), then to the rows.
Digests under which different texts meet are resolved by joining on the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge.llm.common import lower_ascii
from listforge.session import materialize

SALTS = 64


def _digest(text: Column) -> Column:
    return F.xxhash64(text)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     salts: int = SALTS, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The
    largest id of a group stays.  Null ids are smaller than every id; a group of null ids
    only has keep_id null.  Rows that repeat both id and text are one document: each gets
    its row, all with the same verdict.  Other columns of the input are not looked at.  An
    empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("_id"), lower_ascii(F.col(text_col)).alias("_t"))
    keyed = base.select("_id", "_t", digest(F.col("_t")).alias("_d"),
                        F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_s"))
    salted = keyed.groupBy("_d", "_s", "_t").agg(
        F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    winners = salted.repartition("_d").groupBy("_d", "_t").agg(
        F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    verdicts = materialize(winners.select(
        "_d", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.sha2("_t", 256).alias("text_sha256"),
        F.count(F.lit(1)).over(Window.partitionBy("_d")).alias("_texts")), "dedup-verdicts")
    sound = verdicts.where("_texts = 1").drop("_texts")
    narrow = keyed.select("_id", "_d", "_s")
    by_salt = narrow.select("_d", "_s").distinct().join(sound, "_d")
    found = narrow.join(by_salt, ["_d", "_s"])
    if not verdicts.where("_texts > 1").isEmpty():
        # different texts under one digest: the text itself decides, on those rows only
        mixed = verdicts.where("_texts > 1").select("_d").distinct()
        rows = keyed.join(mixed, "_d", "left_semi").withColumn("text_sha256", F.sha2("_t", 256))
        groups = winners.join(mixed, "_d", "left_semi").select(
            "_t", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
        found = found.unionByName(rows.join(groups, "_t").drop("_t"))
    return found.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without its exact duplicates, columns as they are.

    Of rows that repeat the kept document's id with an equal text, the largest row stays.
    """
    kept = exact_duplicates(docs, id_col, text_col).where("kept").groupBy(
        F.col(id_col).alias("_k"), F.col("text_sha256").alias("_h")).agg(
        F.count(F.lit(1)).alias("_rows"))
    kept = materialize(kept, "dedup-kept")
    # the input goes along as one struct, so its column names meet none of these
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"),
                       F.sha2(lower_ascii(F.col(text_col)), 256).alias("_own_h"))
    rows = full.join(kept, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_own_h") == F.col("_h")))
    single = rows.where("_rows = 1").select("_row.*")
    if kept.where("_rows > 1").isEmpty():
        return single
    again = rows.where("_rows > 1").groupBy("_k", "_h").agg(F.max("_row").alias("_row")).select("_row.*")
    return single.unionByName(again)
