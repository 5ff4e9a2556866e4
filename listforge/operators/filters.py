"""Projections, filters and predicates.

All of them are column expressions, so Catalyst pushes them into the Parquet
scan where the predicate allows (B3, B15) and keeps them in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listforge import schemas as S
from listforge.functions import columns as C


def flatten_listing(df: DataFrame) -> DataFrame:
    """B1: nested listing -> flat columns; missing title/city/employer -> ''."""
    return df.select(
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("location.city"), F.lit("")).alias("city"),
        F.coalesce(F.col("employer"), F.lit("")).alias("employer"),
        F.col("ref_id"),
        F.col("external_url"),
        F.col("modified_at"),
        F.col("published_on"),
    )


def keyword_hit(title: Column, keywords: list[str]) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    arr = F.array(*[F.lit(k.lower()) for k in keywords]) if keywords else \
        F.array().cast("array<string>")
    return F.exists(arr, lambda k: low.contains(k))


def exclude_keywords(df: DataFrame, keywords: list[str] | None = None,
                     title_col: str = "title") -> DataFrame:
    """B2: drop rows whose lower-cased title contains any keyword (missing title kept)."""
    kws = S.DEFAULT_EXCLUDE_KEYWORDS if keywords is None else keywords
    if not kws:
        return df
    return df.where(~keyword_hit(F.col(title_col), kws))


def date_part(date: Column, unit: str) -> Column:
    """The partition a date falls into: its day, or the first day of its month."""
    return date.cast("date") if unit == "DAY" else F.trunc(date, unit).cast("date")


def published_within(df: DataFrame, as_of: str, days: int | None, date_col: str = "published_on",
                     part_col: str | None = None, unit: str = "DAY") -> DataFrame:
    """Published in the last ``days`` days before ``as_of``; None keeps everything.

    Plain comparisons with literals: on a table in folders by ``part_col`` (``date_part`` of
    the date) older partitions are not listed, and inside files the date is a pushed filter.
    """
    if days is None:
        return df
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), int(days))
    if part_col:
        df = df.where(F.col(part_col) >= date_part(cutoff, unit))
    if isinstance(df.schema[date_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        # date(ts) >= d  <=>  ts >= d 00:00, and the column stays bare (pushable)
        return df.where(F.col(date_col) >= cutoff.cast(df.schema[date_col].dataType))
    return df.where(F.col(date_col) >= cutoff)


def incremental_window(explicit_days: int | None, store_exists: bool, has_history: bool,
                       default_days: int = S.DEFAULT_INCREMENTAL_DAYS) -> int | None:
    """Explicit N wins; a repeated (query, place) on an existing store -> default; else all."""
    if explicit_days is not None:
        return explicit_days
    if store_exists and has_history:
        return default_days
    return None


def incremental_window_col(explicit_days: Column, store_exists: Column, has_history: Column,
                           default_days: int = S.DEFAULT_INCREMENTAL_DAYS) -> Column:
    """B4 as a column (for plans that keep the choice inside Spark)."""
    return (F.when(explicit_days.isNotNull(), explicit_days)
            .when(store_exists & has_history, F.lit(default_days))
            .otherwise(F.lit(None).cast("int")))


def require_ref(df: DataFrame, ref_col: str = "ref_id") -> DataFrame:
    """Rows with a missing or empty ref are skipped."""
    return df.where(F.coalesce(F.col(ref_col), F.lit("")) != "")


def matches_only(df: DataFrame) -> DataFrame:
    """Rows carrying Excellent or Good."""
    return df.where(C.is_match("categories"))


def text_search(df: DataFrame, query: str | None, cols: list[str]) -> DataFrame:
    """Case-insensitive substring over the given columns; empty query keeps all."""
    q = (query or "").strip().lower()
    if not q:
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return df.where(hit)


def category_filter(df: DataFrame, category: str | None, col: str = "display_category") -> DataFrame:
    """One display category, or all when None / 'all'."""
    if category is None or category == "all":
        return df
    return df.where(F.col(col) == category)


def size_guard(df: DataFrame, limit: int = S.MAX_TEXT_CHARS, ref_col: str = "ref_id",
               text_col: str = "text") -> DataFrame:
    """Rows whose text would be cut (ref, length, limit, loss); non-empty fails the run."""
    n = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    return df.where(n > limit).select(
        F.col(ref_col).alias("ref_id"), n.alias("length"), F.lit(limit).cast("long").alias("limit"),
        (n - F.lit(limit)).alias("loss"))


class OversizeTextError(RuntimeError):
    """A text longer than the limit: the run fails instead of cutting it."""


def disable_listing(store: DataFrame, disable: DataFrame,
                    default_reason: str = S.DEFAULT_DISABLE_REASON) -> tuple[DataFrame, DataFrame]:
    """Mark listings as failed with a reason; returns (new store, report).

    ``disable`` has ``ref_id`` and optional ``reason``.  Rows with DETAILS get
    text := reason, success := false, warning := EXCESSIVE_CONTENT, error := reason,
    text_length := len(reason).  The report lists every requested ref with
    ``found`` (in the store) and ``changed`` (it had DETAILS).
    """
    reason = F.coalesce(F.col("reason"), F.lit(default_reason)) if "reason" in disable.columns \
        else F.lit(default_reason)
    req = disable.select("ref_id", reason.alias("_reason")).dropDuplicates(["ref_id"])
    joined = store.join(req, "ref_id", "left")
    d = F.col("details")
    disabled = (d.withField("text", F.col("_reason")).withField("success", F.lit(False))
                .withField("warning", F.lit(S.WARN_EXCESSIVE_CONTENT))
                .withField("error", F.col("_reason"))
                .withField("text_length", F.length("_reason").cast("long")))
    new_store = joined.withColumn(
        "details", F.when(F.col("_reason").isNotNull() & d.isNotNull(), disabled).otherwise(d)
    ).drop("_reason").select(*store.columns)
    found = store.select("ref_id", F.col("details").isNotNull().alias("changed"))
    report = req.join(found, "ref_id", "left").select(
        "ref_id", F.col("changed").isNotNull().alias("found"),
        F.coalesce(F.col("changed"), F.lit(False)).alias("changed"))
    return new_store, report


def get_listing(store: DataFrame, ref_id: str) -> DataFrame:
    """Point lookup (an equality predicate the Parquet scan can skip row groups with)."""
    return store.where(F.col("ref_id") == F.lit(ref_id))


def search_index(index: DataFrame, query: str | None, cols: list[str],
                 batch_col: str = "batch_no") -> DataFrame:
    """B11 on the reasoning index: matching rows with their batch's visible-row count.

    Batches without a hit are absent; the per-batch count is re-aggregated from
    the visible rows only.
    """
    hits = text_search(index, query, cols)
    visible = hits.groupBy(batch_col).agg(F.count(F.lit(1)).alias("visible_in_batch"))
    return hits.join(visible, batch_col)
