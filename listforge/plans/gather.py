"""Compositions: gather (J11), its summary (E14) and the full run.

gather: load store -> context guard -> choose the recency window (B4) -> land the
pages (paging + keyword rules, A2/B2, once) -> recency filter on their date partitions (B3) -> merge
(C1, touched buckets only) -> new + updated (H1) -> extract (X12) -> split (B7) ->
attach details (C2) -> save the touched buckets (A4/E15) and their statistics -> summary (E14).
Driver-side decisions use one bounded action each (``isEmpty``, one-row reads).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import extract as X
from listforge.operators import filters as FL
from listforge.operators import store as ST
from listforge.operators import store_stats as SS
from listforge.sources import search_pages as SP
from listforge.session import materialize, scratch_path
from listforge.sources import store_io as IO


@dataclass
class GatherResult:
    ok: DataFrame | None
    failed: DataFrame | None
    summary: DataFrame
    to_process: DataFrame | None = None
    save: int | None = None
    found: DataFrame | None = None
    window_days: int | None = None
    bad_pages: DataFrame | None = None


def gather_summary(found: DataFrame, processed: DataFrame | None, ok: DataFrame | None,
                   failed: DataFrame | None, per_ref: DataFrame | None,
                   store: DataFrame | None) -> DataFrame:
    """total_found, total_scraped, extracted, failed and the delta counts (one row)."""
    from listforge.operators.report import fold_rows

    parts = [found.agg(F.count(F.lit(1)).alias("total_found"))]
    spark = found.sparkSession
    zero = lambda name: spark.range(1).select(F.lit(0).cast("long").alias(name))
    parts.append(processed.agg(F.count(F.lit(1)).alias("total_scraped")) if processed is not None
                 else zero("total_scraped"))
    parts.append(ok.agg(F.count(F.lit(1)).alias("extracted")) if ok is not None
                 else zero("extracted"))
    parts.append(failed.agg(F.count(F.lit(1)).alias("failed")) if failed is not None
                 else zero("failed"))
    if per_ref is not None and store is not None:
        parts.append(ST.delta_summary(per_ref, store).withColumnRenamed(
            "total_in_store", "database_total"))
    return fold_rows(*parts)


def recent_listings(spark: SparkSession, landed_root: str, landing_id: str, as_of: str, days: int | None) -> DataFrame:
    """The landed listings of the window; older date partitions are not read."""
    rows = FL.published_within(SP.read_landed(spark, landed_root, landing_id), as_of, days, part_col=SP.PART)
    return rows.drop(SP.PART)


def gather(spark: SparkSession, landing: str | None, store_root: str, pages: DataFrame | None,
           query: str | None, place: str | None, radius_km: int | None, as_of: str,
           internal_base_url: str, max_pages: int | None = None, keywords: list[str] | None = None,
           days: int | None = None, enable_extraction: bool = True,
           use_store: bool = True, landed_root: str | None = None, landing_id: str = "search") -> GatherResult:
    """J11 over landed search pages and landed HTML (``pages``: url, html[, http_status]).

    The pages under ``landing`` are landed in ``landed_root`` (a scratch folder by default);
    without ``landing`` the listings landed there before under ``landing_id`` are taken.
    """
    store_exists = use_store and IO.store_exists(spark, store_root)
    meta = IO.load_metadata(spark, store_root) if store_exists else None
    if store_exists:
        ST.check_context(meta, place, radius_km)
    history = store_exists and ST.has_search_history(IO.load_store(spark, store_root), query, place)
    window = FL.incremental_window(days, store_exists, history)
    if use_store and not store_exists:
        meta = {"created": None, "place": place, "radius_km": radius_km}

    landed_root = landed_root or scratch_path(spark, "landed")
    if landing is not None:
        SP.land_search_pages(spark, landing, landed_root, landing_id, max_pages, keywords)
    bad = spark.read.parquet(f"{landed_root.rstrip('/')}/bad_pages/landing={landing_id}")
    # the recent listings feed the emptiness check, the merge and the summary: write once
    found = materialize(recent_listings(spark, landed_root, landing_id, as_of, window), "found")
    if found.isEmpty():  # K19: nothing found, store untouched
        summary = gather_summary(found, None, None, None, None, None)
        if store_exists:
            from listforge.operators.report import fold_rows

            zero = F.lit(0).cast("long")
            summary = fold_rows(summary, IO.load_store(spark, store_root).agg(
                zero.alias("new"), zero.alias("updated"), zero.alias("unchanged"),
                F.count(F.lit(1)).alias("database_total")))
        return GatherResult(None, None, summary, found=found, window_days=window, bad_pages=bad)

    if not use_store:
        processed = found
        per_ref = None
        new_store = None
    else:
        merged = ST.merge_saved(spark, store_root, found, query, place, as_of)
        touched = IO.touched_buckets(spark, store_root, found) if store_exists else None
        # H1: new rows first, then updated ones, each in arrival order
        processed = merged.to_process().drop("status", "prior_stamp")
        per_ref, new_store = merged.per_ref, merged.store

    if processed.isEmpty() or not enable_extraction:
        snap = None
        if use_store:
            snap = IO.save_touched(spark, store_root, new_store,
                                   lambda w: ST.store_metadata(w, meta, as_of, place, radius_km))
            SS.refresh_stats(spark, store_root, touched)
            new_store = IO.load_store(spark, store_root)
        flat = FL.flatten_listing(processed) if enable_extraction is False else None
        summary = gather_summary(found, processed, processed if not enable_extraction else None,
                                 None, per_ref, new_store)
        return GatherResult(flat, None, summary, processed, snap, found, window, bad)

    # the Python extraction is the costly step: run it once, persist its output (A10's
    # scraped table) and derive the split, the store update and the summary from it
    detailed = materialize(X.extract_listings(processed, pages, internal_base_url), "scraped")
    ok, failed = X.split_outcomes(detailed, internal_base_url)
    snap = None
    if use_store:
        with_details = ST.attach_details(new_store, detailed.select("ref_id", "batch_ord",
                                                                     "details"))
        snap = IO.save_touched(spark, store_root, with_details,
                               lambda w: ST.store_metadata(w, meta, as_of, place, radius_km))
        SS.refresh_stats(spark, store_root, touched)
        new_store = IO.load_store(spark, store_root)
    summary = gather_summary(found, detailed, ok, failed, per_ref, new_store)
    return GatherResult(ok, failed, summary, processed, snap, found, window, bad)


def full_run(spark: SparkSession, landing: str, store_root: str, run_root: str,
             pages: DataFrame, query: str | None, place: str | None, radius_km: int | None,
             as_of: str, internal_base_url: str, scorer, profile: str, run_id: str,
             return_only_matches: bool = False, **gather_kwargs) -> tuple[DataFrame, DataFrame]:
    """Gather -> label (with resume) -> dashboard.  Returns (labelled rows, dashboard)."""
    from listforge.operators import report as RP
    from listforge.operators import runs as R

    g = gather(spark, landing, store_root, pages, query, place, radius_km, as_of,
               internal_base_url, **gather_kwargs)
    if g.ok is None:
        empty = spark.createDataFrame([], R.PARTIAL_SCHEMA)
        return empty, g.summary
    labelled = R.resume_classify(g.ok, scorer, profile, run_id, run_root,
                                 order_cols=[c for c in ("process_ord", "batch_ord") if c in g.ok.columns] or None,
                                 return_only_matches=False)
    returned = labelled.where(F.lit(True))
    if return_only_matches:
        from listforge.functions.columns import is_match

        returned = labelled.where(is_match("categories"))
    dash = RP.run_dashboard(g.found, g.ok, labelled, returned)
    return returned, dash


__all__ = ["gather", "gather_summary", "full_run", "GatherResult", "S"]
