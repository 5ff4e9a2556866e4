"""Merge listing files landing in a directory into the keyed store.

The state of the merge is the store: its rows hold the stamp in force of every ref.  Of a
micro-batch only (ref, order, stamp, file) take part in the ordered step, the one of the
batch merge, over the stamps of the buckets that hold the batch's refs.  It gives per ref the
order and file of the row whose payload wins; those payloads are read back from the landed
files, and the same buckets are rewritten.  All of it are column expressions.

A new checkpoint on an old store continues it.  A replayed micro-batch whose save is recorded
under its tag (query id and batch number) is skipped; one that died before that is merged
again, which gives the same store.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import store as ST
from listforge.session import materialize
from listforge.sources import store_io as IO


def _as_fn(value):
    return value if callable(value) else (lambda _batch_id: value)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The streaming query's id, from the metadata file Spark writes before the first batch."""
    meta = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(meta)["id"].replace("-", "")


def winners_of(batch: DataFrame, stored: DataFrame, only_newer: bool = False) -> DataFrame:
    """(ref_id, ord, stamp, file) rows -> one row per ref: order and file of the row that wins.

    ``eff_ord`` is null where no row changes what ``stored`` (ref_id, stamp) has of the ref.
    """
    known = stored.join(batch.select("ref_id").distinct(), "ref_id", "left_semi").select(
        "ref_id", F.lit(-1).cast("long").alias("ord"), "stamp", F.lit(None).cast("string").alias("file"),
        F.lit(True).alias("is_store"))
    seq = ST.prior_stamps(batch.withColumn("is_store", F.lit(False)).unionByName(known), only_newer=only_newer)
    status = ST.status_of(F.col("stamp"), F.col("prior_stamp"), F.col("seen_before"), only_newer)
    effect = F.when(~F.col("is_store") & status.isin(ST.NEW, ST.UPDATED), F.struct("ord", "file"))
    return seq.groupBy("ref_id").agg(F.max(effect).alias("eff")).select(
        "ref_id", F.col("eff.ord").alias("eff_ord"), F.col("eff.file").alias("eff_file"))


def save_winners(spark: SparkSession, winners: DataFrame, tag: str, store_root: str, query: str | None,
                 place: str | None, radius_km: int | None, as_of: str) -> None:
    """Write one micro-batch's winners into the buckets of their refs."""
    if IO.was_saved(spark, store_root, tag):
        return  # replay of a batch that was already saved
    meta = IO.load_metadata(spark, store_root)
    ST.check_context(meta, place, radius_km)
    if meta is None:
        meta = {"created": None, "place": place, "radius_km": radius_km}
    winners = materialize(winners, "stream-winners")  # the ordered step runs once
    if winners.isEmpty():
        return
    files = [r["eff_file"] for r in winners.select("eff_file").distinct().collect() if r["eff_file"]]  # of this batch
    landed = spark.read.schema(S.LISTING).parquet(*files) if files else spark.createDataFrame([], S.LISTING)
    payload = landed.select("ref_id", F.col("batch_ord").alias("eff_ord"), *S.PAYLOAD_FIELDS).join(
        winners.select("ref_id", "eff_ord"), ["ref_id", "eff_ord"], "left_semi").dropDuplicates(["ref_id"])
    touched = winners.select("ref_id", "eff_ord").join(payload.drop("eff_ord"), "ref_id", "left")
    stored = IO.load_store(spark, store_root, IO.touched_buckets(spark, store_root, winners))
    rows = ST.apply_touched(stored, touched, query, place, F.to_timestamp(F.lit(as_of)))
    IO.save_touched(spark, store_root, rows,
                    lambda written: ST.store_metadata(written, meta, as_of, place, radius_km), tag=tag)


def stream_merge(spark: SparkSession, in_dir: str, store_root: str, checkpoint: str,
                 query: str | None | Callable, place: str | None, radius_km: int | None,
                 as_of: str | Callable, max_files_per_trigger: int | None = None,
                 available_now: bool = True, only_newer: bool = False):
    """Start (and, with ``available_now``, finish) the merge stream.

    ``maxFilesPerTrigger`` bounds a micro-batch.  Of rows that repeat ref and order one wins.
    With ``only_newer`` a stamp that is not larger than the largest one before it changes
    nothing, as in ``merge_listings``.
    """
    query_fn, as_of_fn = _as_fn(query), _as_fn(as_of)
    reader = spark.readStream.schema(S.LISTING)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rows = reader.parquet(in_dir).where(F.coalesce(F.col("ref_id"), F.lit("")) != "").select(
        "ref_id", F.col("batch_ord").alias("ord"), F.nullif(F.col("modified_at"), F.lit("")).alias("stamp"),
        F.col("_metadata.file_path").alias("file"))

    def per_batch(df: DataFrame, batch_id: int) -> None:
        tag = f"{_query_id(spark, checkpoint)}-{batch_id:012d}"
        if IO.was_saved(spark, store_root, tag):
            return
        batch = materialize(df, "stream-keys")
        stored = IO.load_store(spark, store_root, IO.touched_buckets(spark, store_root, batch)).select(
            "ref_id", F.nullif(F.col("modified_at"), F.lit("")).alias("stamp"))
        save_winners(spark, winners_of(batch, stored, only_newer), tag, store_root, query_fn(batch_id), place, radius_km,
                     as_of_fn(batch_id))

    writer = rows.writeStream.outputMode("append").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    handle = writer.start()
    if available_now:
        handle.awaitTermination()
    return handle
