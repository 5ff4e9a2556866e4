"""Keyed listing store: merge with change classification, details, history (C1, C2, C6,
F1, F1b, F6, E13, E15).

Merge semantics (one incoming batch, arrival order ``batch_ord``):
- rows without a ref are skipped;
- the first occurrence of an unknown ref is *new*;
- a later occurrence (or a ref already stored) is *updated* when its stamp is
  non-empty and differs from the stamp in force, else *unchanged*; the stamp
  in force is the last non-empty stamp seen before it (store row first);
- the store keeps the payload of the ref's last new/updated row (details are
  dropped with it) or, without one, its stored payload; every ref seen gets
  ``last_seen`` = as_of and the (query, place) pair appended once.

Scale plan: only (ref, ord, stamp) take part in the ordered step, written once and cut into
ranges of (ref, ord) of about equal size.  The stamp in force is computed in two levels:
windows per (ref, range), and each range's last stamp carried forward over a table with one
row per (ref, range), so a ref with a third of all rows is spread over many ranges however
its orders are numbered.  Winning payloads join back on the unique (ref, ord) key.  On the
stored table, ``merge_saved`` reads only the hash buckets that the batch's refs fall into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.session import materialize
from listforge.sources import store_io as IO

NEW, UPDATED, UNCHANGED = "new", "updated", "unchanged"


class ContextMismatchError(ValueError):
    """The store is locked to another (place, radius)."""


@dataclass
class MergeResult:
    classified: DataFrame  # incoming rows with a ref, plus ``status`` and ``prior_stamp``
    store: DataFrame       # the next store rows (STORE columns)
    per_ref: DataFrame     # one row per incoming ref: eff_ord, in_store, has_new/updated/unchanged

    def rows(self, status: str) -> DataFrame:
        return self.classified.where(F.col("status") == status)

    @property
    def new(self) -> DataFrame:
        return self.rows(NEW)

    @property
    def updated(self) -> DataFrame:
        return self.rows(UPDATED)

    @property
    def unchanged(self) -> DataFrame:
        return self.rows(UNCHANGED)

    def to_process(self) -> DataFrame:
        """H1: new rows then updated rows (a ref may appear in both)."""
        return to_process(self.classified)


def empty_store(spark) -> DataFrame:
    return spark.createDataFrame([], S.STORE)


def check_context(meta: dict | None, place: str | None, radius_km: int | None) -> None:
    """C1 precondition: a stored (place, radius) must equal the requested one."""
    if not meta:
        return
    stored_place, stored_radius = meta.get("place"), meta.get("radius_km")
    if stored_place is None and stored_radius is None:
        return
    if stored_place != place or stored_radius != radius_km:
        where = lambda p, r: f"{p or 'everywhere'} ({r} km)"
        raise ContextMismatchError(
            f"store is locked to {where(stored_place, stored_radius)}, "
            f"search asks for {where(place, radius_km)}")


def prior_stamps(seq: DataFrame, parts: int | None = None, only_newer: bool = False) -> DataFrame:
    """F1 on (ref_id, ord, stamp[, is_store]): adds ``prior_stamp`` and ``seen_before``.

    ``stamp`` must already be null for empty stamps.  ``prior_stamp`` is the last stamp
    before the row, or the largest one with ``only_newer``.  Exact for any number of ranges.
    """
    ranged = seq.repartitionByRange(parts, "ref_id", "ord") if parts else seq.repartitionByRange("ref_id", "ord")
    # the range numbers become a written column, so they stay fixed if a task is retried
    s = materialize(ranged.withColumn("_range", F.spark_partition_id()), "merge-ranges")
    w_local = Window.partitionBy("ref_id", "_range").orderBy("ord")
    w_ref = Window.partitionBy("ref_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    if only_newer:
        in_force, of_range = F.max, F.max("stamp")
    else:
        def in_force(c):
            return F.last(c, ignorenulls=True)

        of_range = F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("ord")))
    local = (s.withColumn("_local_prior", in_force("stamp").over(w_local.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("_local_rn", F.row_number().over(w_local)))
    carry = s.groupBy("ref_id", "_range").agg(of_range.alias("_of_range")).select(
        "ref_id", "_range", in_force("_of_range").over(w_ref).alias("_carry"),
        (F.count(F.lit(1)).over(w_ref) > 0).alias("_prev_range"))
    out = local.join(carry, ["ref_id", "_range"], "left")
    prior = F.greatest("_local_prior", "_carry") if only_newer else F.coalesce("_local_prior", "_carry")
    return out.select(
        *seq.columns, prior.alias("prior_stamp"),
        ((F.col("_local_rn") > 1) | F.coalesce("_prev_range", F.lit(False))).alias("seen_before"))


def status_of(stamp: Column, prior: Column, seen_before: Column, only_newer: bool = False) -> Column:
    changed = (prior.isNull() | (stamp > prior)) if only_newer else ~stamp.eqNullSafe(prior)
    return (F.when(~seen_before, F.lit(NEW))
            .when(stamp.isNotNull() & changed, F.lit(UPDATED))
            .otherwise(F.lit(UNCHANGED)))


def classify_batch(store: DataFrame, incoming: DataFrame, parts: int | None = None,
                   only_newer: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C1 classification: (classified incoming rows, per-ref summary, winning rows).

    ``incoming`` needs ref_id, batch_ord, modified_at (plus any payload).  Its keys are read
    once and written; its payload is read where the classified rows or the winners are used.
    """
    inc = incoming.where(F.coalesce(F.col("ref_id"), F.lit("")) != "")
    stamp = F.nullif(F.col("modified_at"), F.lit("")).alias("stamp")
    keys = materialize(inc.select("ref_id", F.col("batch_ord").cast("long").alias("ord"), stamp,
                                  F.lit(False).alias("is_store")), "merge-keys")
    stored = store.select("ref_id", F.lit(-1).cast("long").alias("ord"), stamp, F.lit(True).alias("is_store")).join(
        keys.select("ref_id").distinct(), "ref_id", "left_semi")
    seq = prior_stamps(keys.unionByName(stored), parts, only_newer)
    status = status_of(F.col("stamp"), F.col("prior_stamp"), F.col("seen_before"), only_newer)
    # narrow, read by the statuses and by the summary
    seq = materialize(seq.withColumn("status", F.when(~F.col("is_store"), status)), "merge-seq")
    per_ref = seq.groupBy("ref_id").agg(
        F.max(F.when(F.col("status").isin(NEW, UPDATED), F.col("ord"))).alias("eff_ord"),
        F.max(F.col("is_store").cast("int")).cast("boolean").alias("in_store"),
        *[F.coalesce(F.max((F.col("status") == s).cast("int")), F.lit(0)).cast("boolean").alias(f"has_{s}")
          for s in (NEW, UPDATED, UNCHANGED)],
    )
    statuses = seq.where(~F.col("is_store")).select(
        "ref_id", F.col("ord").alias("batch_ord"), "status", "prior_stamp")
    classified = inc.join(statuses, ["ref_id", "batch_ord"])
    payload = inc.select("ref_id", F.col("batch_ord").alias("eff_ord"), *S.PAYLOAD_FIELDS)
    touched = per_ref.select("ref_id", "eff_ord", "in_store").join(payload, ["ref_id", "eff_ord"], "left")
    return classified, per_ref, touched


def to_process(classified: DataFrame) -> DataFrame:
    """H1: new rows followed by updated rows, each in arrival order (bag union)."""
    return (classified.where(F.col("status").isin(NEW, UPDATED))
            .withColumn("process_ord", F.when(F.col("status") == NEW, 0).otherwise(1)))


def append_search(found_in: Column, query: str | None, place: str | None, as_of: Column) -> Column:
    """append (query, place, as_of) unless the (query, place) pair is already there."""
    q, p = F.lit(query).cast("string"), F.lit(place).cast("string")
    current = F.coalesce(found_in, F.array().cast(S.FOUND_IN))
    entry = F.array(F.struct(q.alias("query"), p.alias("place"), as_of.alias("first_match")))
    present = F.exists(current, lambda s: s["query"].eqNullSafe(q) & s["place"].eqNullSafe(p))
    return F.when(present, current).otherwise(F.concat(current, entry))


def merge_listings(store: DataFrame, incoming: DataFrame, query: str | None, place: str | None,
                   as_of: str, parts: int | None = None, only_newer: bool = False) -> MergeResult:
    """Classify ``incoming`` against ``store`` and build the next store rows.

    With ``only_newer`` [ours] a stamp that is not larger (as text) than the largest one
    before it, stored or in the batch, leaves its row unchanged; by default a late older
    version counts as a change, because only inequality is tested.
    """
    classified, per_ref, touched = classify_batch(store, incoming, parts, only_newer)
    return MergeResult(classified=classified, per_ref=per_ref,
                       store=apply_touched(store, touched, query, place, F.to_timestamp(F.lit(as_of))))


def apply_touched(store: DataFrame, touched: DataFrame, query: str | None, place: str | None,
                  ts: Column) -> DataFrame:
    """The next rows of ``store``: ``touched`` has a row per ref seen, with the payload that wins.

    A row without ``eff_ord`` was seen unchanged.  A ref that is not stored yet is added.
    """
    s, t = {c: F.col("s." + c) for c in store.columns}, {c: F.col("t." + c) for c in touched.columns}
    has_eff, seen = t["eff_ord"].isNotNull(), t["ref_id"].isNotNull()
    both = store.alias("s").join(touched.alias("t"), F.col("s.ref_id") == F.col("t.ref_id"), "full")
    return both.select(
        F.coalesce(s["ref_id"], t["ref_id"]).alias("ref_id"),
        *[F.when(has_eff, t[c]).otherwise(s[c]).alias(c) for c in S.PAYLOAD_FIELDS],
        F.when(s["ref_id"].isNull(), ts).otherwise(s["first_seen"]).alias("first_seen"),
        F.when(seen, ts).otherwise(s["last_seen"]).alias("last_seen"),
        F.when(seen, append_search(s["found_in"], query, place, ts)).otherwise(s["found_in"]).alias("found_in"),
        F.when(has_eff, F.lit(None).cast(S.DETAILS)).otherwise(s["details"]).alias("details"),
    )


def merge_saved(spark, root: str, incoming: DataFrame, query: str | None, place: str | None, as_of: str,
                only_newer: bool = False) -> MergeResult:
    """C1 against the store saved at ``root``: reads the touched buckets, whose next rows
    ``.store`` holds, to be written by ``store_io.save_touched``."""
    stored = IO.load_store(spark, root, IO.touched_buckets(spark, root, incoming))
    return merge_listings(stored, incoming, query, place, as_of, only_newer=only_newer)


def delta_summary(per_ref: DataFrame, store: DataFrame) -> DataFrame:
    """Refs per status (a ref may count in two) and the store total (one row).

    ``per_ref`` is a merge's one row per incoming ref, so flags are counted, not refs.
    """
    total = store.agg(F.count(F.lit(1))).scalar()
    return per_ref.agg(*[F.count_if(F.col(f"has_{s}")).alias(s) for s in (NEW, UPDATED, UNCHANGED)]).withColumn(
        "total_in_store", total)


def attach_details(store: DataFrame, details: DataFrame) -> DataFrame:
    """Set DETAILS of stored refs that were just extracted; unknown refs ignored.

    ``details`` has ref_id and a DETAILS struct; rows with an empty ref or null details are
    ignored.  Of several rows of a ref the last by ``batch_ord`` wins (ties, and tables
    without that column: the largest row hash); the winner is found on narrow keys before
    any text is shuffled.
    """
    d = details.where((F.coalesce(F.col("ref_id"), F.lit("")) != "") & F.col("details").isNotNull())
    order = F.struct(F.col("batch_ord") if "batch_ord" in d.columns else F.lit(0), F.xxhash64("details"))
    d = d.select("ref_id", order.alias("_order"), F.col("details").alias("_new_details"))
    last = d.groupBy("ref_id").agg(F.max("_order").alias("_order"))
    d = d.join(last, ["ref_id", "_order"]).dropDuplicates(["ref_id"])  # equal rows only
    joined = store.join(d.drop("_order"), "ref_id", "left")
    return joined.withColumn("details", F.coalesce(F.col("_new_details"), F.col("details"))) \
        .drop("_new_details").select(*store.columns)


def recorded(query: str | None, place: str | None) -> Column:
    """Whether a stored listing was found by (query, place); null equals null."""
    q, p = F.lit(query).cast("string"), F.lit(place).cast("string")
    return F.exists(F.coalesce(F.col("found_in"), F.array().cast(S.FOUND_IN)),
                    lambda s: s["query"].eqNullSafe(q) & s["place"].eqNullSafe(p))


def search_history_flags(store: DataFrame, searches: dict) -> DataFrame:
    """C6 as one row with a boolean per name of ``searches`` (name -> (query, place)), in one pass."""
    return store.agg(*[F.coalesce(F.max(recorded(*s).cast("int")), F.lit(0)).cast("boolean").alias(name)
                       for name, s in searches.items()])


def has_search_history(store: DataFrame, query: str | None, place: str | None) -> bool:
    """C6 for the driver: stops at the first hit (``limit(1)``)."""
    return bool(store.where(recorded(query, place)).limit(1).count())


def store_metadata(store: DataFrame, previous: dict | None, as_of: str, place: str | None,
                   radius_km: int | None) -> DataFrame:
    """Created kept from the first save, last_updated, total = active = row count."""
    prev = previous or {}
    created = prev.get("created")
    has_ctx = prev.get("place") is not None or prev.get("radius_km") is not None
    ctx_place = prev.get("place") if has_ctx else place
    ctx_radius = prev.get("radius_km") if has_ctx else radius_km
    ts = F.to_timestamp(F.lit(as_of))
    return store.agg(F.count(F.lit(1)).alias("total")).select(
        (F.lit(created).cast("timestamp") if created is not None else ts).alias("created"),
        ts.alias("last_updated"),
        F.col("total").cast("long").alias("total"),
        F.col("total").cast("long").alias("active"),
        F.lit(ctx_place).cast("string").alias("place"),
        F.lit(ctx_radius).cast("int").alias("radius_km"),
    )
