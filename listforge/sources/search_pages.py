"""Landed search-response pages.

A landed page is one JSON object per line: ``page``, ``status`` (HTTP status of
the fetch), ``total`` (string or number) and ``listings``.  Reading keeps page
order and the position inside the page as ``batch_ord``.

``page_prefix`` applies the paging rules of one search (or of each search
when ``search_col`` is given): pages are taken from 1 upward; reading stops
*before* the first missing, failed or empty page, *after* ``max_pages``, and
*after* the first page where the running count of kept (keyword-filtered)
listings reaches that page's total (a missing total counts as 0).

A line that is no whole JSON object is a bad page: it is reported with its file and counts as
a failed page under the number that can still be read from it, so paging stops before it.

``land_search_pages`` parses pages once, applies those rules and writes the kept listings in
folders by landing and publication date, where ``published_within`` prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listforge import schemas as S
from listforge.operators.filters import date_part, keyword_hit
from listforge.operators.indexing import running_sum
from listforge.session import materialize

POS_BITS = 32
BAD_STATUS = 0           # of a page whose line is broken: no HTTP status, so never a good one
PART = "published_part"  # the partition column of landed listings
_BROKEN = "_corrupt_record"
_LANDED = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("pos", T.IntegerType()),
    T.StructField("batch_ord", T.LongType()), *S.SEARCH_PAGE["listings"].dataType.elementType.fields,
    T.StructField("landing", T.StringType()), T.StructField(PART, T.DateType())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """A row per line: file, line, the parsed page ``p`` and whether it is ``bad``; folder columns stay."""
    lines = spark.read.text(path)
    schema = T.StructType([*S.SEARCH_PAGE.fields, T.StructField(_BROKEN, T.StringType())])
    page = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    rows = lines.where(F.trim("value") != "").select(
        *[c for c in lines.columns if c != "value"], F.col("_metadata.file_path").alias("file"),
        F.col("value").alias("line"), page.alias("p"))
    # a single odd field gives a corrupt record too, but its listings are there
    return rows.withColumn("bad", F.col(f"p.{_BROKEN}").isNotNull() & F.col("p.listings").isNull())


def _number():
    """The page number as far as a broken line shows it, or the empty text."""
    return F.regexp_extract("line", r'"page"\s*:\s*"?(\d{1,9})\b', 1)


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1 reader: landed JSON pages with an explicit schema (no inference); bad pages as failed ones."""
    rows = _lines(spark, path)
    keys = [c for c in rows.columns if c not in ("file", "line", "p", "bad")]
    number = F.nullif(_number(), F.lit("")).cast("int")
    return rows.where(~F.col("bad") | number.isNotNull()).select(
        *keys, F.when(F.col("bad"), number).otherwise(F.col("p.page")).alias("page"),
        F.when(F.col("bad"), F.lit(BAD_STATUS)).otherwise(F.col("p.status")).alias("status"),
        F.when(~F.col("bad"), F.col("p.total")).alias("total"),
        F.when(~F.col("bad"), F.col("p.listings")).alias("listings"))


def bad_pages(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are no whole page: file, page (null if unreadable), length, head (200 characters)."""
    rows = _lines(spark, path).where("bad")
    keys = [c for c in rows.columns if c not in ("file", "line", "p", "bad")]
    return rows.select(*keys, "file", F.nullif(_number(), F.lit("")).cast("int").alias("page"),
                       F.length("line").cast("long").alias("length"), F.left("line", F.lit(200)).alias("head"))


def write_by_date(rows: DataFrame, path: str, date_col: str = "published_on", unit: str = "DAY",
                  landing_id: str | None = None) -> None:
    """Write rows in folders by the day or month of ``date_col`` (inside the landing's own folder).

    The same landing written again replaces its folders; others are left alone.
    """
    out = rows.withColumn(PART, date_part(F.col(date_col), unit)).hint("rebalance", F.col(PART))
    keys = [PART]
    if landing_id is not None:
        out, keys = out.withColumn("landing", F.lit(landing_id)), ["landing", PART]
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def land_search_pages(spark: SparkSession, path: str, landed_root: str, landing_id: str,
                      max_pages: int | None = None, keywords: list[str] | None = None, unit: str = "DAY") -> None:
    """A1 + A2 + B2 once: ``<root>/listings`` by landing and date, ``<root>/bad_pages`` by landing."""
    root = landed_root.rstrip("/")
    pages = materialize(read_search_pages(spark, path), "parsed-pages")  # paging reads them several times
    write_by_date(page_prefix(pages, max_pages, keywords), f"{root}/listings", unit=unit, landing_id=landing_id)
    bad_pages(spark, path).write.mode("overwrite").parquet(f"{root}/bad_pages/landing={landing_id}")


def read_landed(spark: SparkSession, landed_root: str, landing_id: str) -> DataFrame:
    """The kept listings of one landing, with the partition column for ``published_within``."""
    rows = spark.read.schema(_LANDED).parquet(f"{landed_root.rstrip('/')}/listings")
    return rows.where(F.col("landing") == landing_id).drop("landing")


def page_listings(pages: DataFrame, search_col: str | None = None) -> DataFrame:
    """A1: one row per listing with ``page``, ``pos`` and ``batch_ord`` = (page, pos)."""
    keys = [search_col] if search_col else []
    rows = pages.select(*keys, "page", F.posexplode(F.coalesce(
        F.col("listings"), F.array().cast(S.SEARCH_PAGE["listings"].dataType))).alias("pos", "l"))
    return rows.select(
        *keys, "page", "pos",
        (F.shiftleft(F.col("page").cast("long"), POS_BITS) + F.col("pos")).alias("batch_ord"),
        "l.*")


def page_totals(pages: DataFrame, keywords: list[str] | None = None,
                search_col: str | None = None, title_col: str = "title") -> DataFrame:
    """per page the kept listing count and the running kept count of its search.

    The running count is an exact two-level prefix sum, and a missing earlier
    page is found by an anti join with each page's successor, so one search with
    very many pages is still spread over many tasks.
    """
    kws = S.DEFAULT_EXCLUDE_KEYWORDS if keywords is None else keywords
    keys = [search_col] if search_col else []
    lst = F.coalesce(F.col("listings"), F.array().cast(S.SEARCH_PAGE["listings"].dataType))
    if kws:
        kept = F.size(F.filter(lst, lambda x: ~keyword_hit(x[title_col], kws)))
    else:
        kept = F.size(lst)
    per_page = pages.select(
        *keys, "page", F.coalesce(F.col("status"), F.lit(200)).alias("status"),
        F.size(lst).alias("n_listings"), kept.cast("long").alias("kept"),
        F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"))
    out = running_sum(per_page, keys, "page", "kept")
    # first missing page: 1 when page 1 is absent, else the smallest p + 1 not landed
    present = per_page.select(*keys, "page")
    succ = present.select(*keys, (F.col("page") - 1).alias("page"))
    last_run = present.join(succ, [*keys, "page"], "left_anti")
    gap, has_first = F.min("page") + 1, F.count_if(F.col("page") == 1) > 0
    if not keys:  # one value each: scalar subqueries
        first_missing = F.when(present.agg(has_first).scalar(), last_run.agg(gap).scalar()).otherwise(1)
        return out.withColumn("first_missing", first_missing)
    gaps = present.groupBy(*keys).agg(has_first.alias("_has1")).join(
        last_run.groupBy(*keys).agg(gap.alias("_gap")), keys, "left")
    return (out.join(gaps, keys, "left").withColumn("first_missing", F.when(F.col("_has1"), F.col("_gap")).otherwise(1))
            .drop("_gap", "_has1"))


def page_prefix(pages: DataFrame, max_pages: int | None = None, keywords: list[str] | None = None,
                search_col: str | None = None, title_col: str = "title") -> DataFrame:
    """A2 + B2: the listings a paged search would have returned, in order (no page limit by default)."""
    keys = [search_col] if search_col else []
    t = page_totals(pages, keywords, search_col, title_col)
    if max_pages is not None:
        t = t.where(F.col("page") <= max_pages)
    stop_before = F.when((F.col("status") != 200) | (F.col("n_listings") == 0)
                         | (F.col("page") > F.col("first_missing")), F.col("page"))
    stop_after = F.when(F.col("running") >= F.col("total"), F.col("page"))
    end = F.lit(max_pages if max_pages is not None else (1 << 31) - 1)
    last = F.least(F.coalesce(F.least(F.min(stop_before), F.min("first_missing")) - 1, end),
                   F.coalesce(F.min(stop_after), end), end).alias("last_page")
    kws = S.DEFAULT_EXCLUDE_KEYWORDS if keywords is None else keywords
    rows = page_listings(pages, search_col)
    if kws:
        rows = rows.where(~keyword_hit(F.col(title_col), kws))
    if not keys:
        return rows.where(F.col("page") <= t.agg(last).scalar())
    # one row per search
    limits = t.groupBy(*keys).agg(last)
    return rows.join(limits, keys).where(F.col("page") <= F.col("last_page")).drop("last_page")
