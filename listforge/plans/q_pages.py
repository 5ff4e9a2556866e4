"""Queries for landed search pages.

Binding: `documents` packed into response pages of 100 listings in doc_id order, with the
number of all documents as total, written as JSON lines to a fresh landing folder and read
back.  For `page_prefix` every language is a search of its own with its own pages and total,
so every document is landed and paged; early stops are for the unit tests.  For `bad_pages`
the line of every third page is cut.  The keyword filter drops titles containing 'src1'.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from listforge.operators.indexing import row_positions
from listforge.plans import bindings as B
from listforge.plans.registry import register
from listforge.session import materialize, scratch_path
from listforge.sources import search_pages as SP

PAGE_SIZE = 100
KEYWORDS = ["src1"]


def _listing():
    return F.struct(
        F.col("doc_id").cast("string").alias("ref_id"),
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.col("source").alias("employer"),
        F.struct(F.col("lang").alias("city")).alias("location"),
        F.lit(None).cast("string").alias("external_url"),
        F.lit(None).cast("string").alias("modified_at"),
        F.lit(None).cast("date").alias("published_on"),
    )


def _packed(rows, *keys):
    """Rows with page and pos as response pages."""
    return rows.groupBy(*keys, "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", _listing().alias("l")))),
                    lambda x: x["l"]).alias("listings"))


def _pages(spark, sf):
    d = B.table(spark, sf, "documents")
    w = Window.partitionBy("page").orderBy("doc_id")
    rows = (d.withColumn("page", (F.floor(F.col("doc_id") / PAGE_SIZE) + 1).cast("int"))
            .withColumn("pos", F.row_number().over(w) - 1))
    return _packed(rows).select("page", F.lit(200).alias("status"), F.lit(str(d.count())).alias("total"), "listings")


def landed_pages(spark, sf):
    """Response pages of one search that finds all documents."""
    path = scratch_path(spark, "landing")
    _pages(spark, sf).write.mode("overwrite").json(path)
    return SP.read_search_pages(spark, path)


def landed_searches(spark, sf):
    """Response pages of one search per language, in a folder each, with the search's own total."""
    d = row_positions(B.table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "doc_id"], "at")
    per = d.groupBy(F.col("lang").alias("search")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    d = d.join(per, d["lang"].eqNullSafe(per["search"])).withColumn("nth", F.col("at") - F.col("first"))
    rows = d.withColumn("page", (F.floor(F.col("nth") / PAGE_SIZE) + 1).cast("int")).withColumn(
        "pos", (F.col("nth") % PAGE_SIZE).cast("int"))
    pages = _packed(rows, "search", "n").select(
        "search", "page", F.lit(200).alias("status"), F.col("n").cast("string").alias("total"), "listings")
    path = scratch_path(spark, "landing")
    pages.write.mode("overwrite").partitionBy("search").json(path)
    return materialize(SP.read_search_pages(spark, path), "parsed-pages")


_PAGES_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(doc_id // {PAGE_SIZE} + 1 AS INTEGER) AS page,
         CAST(row_number() OVER (PARTITION BY doc_id // {PAGE_SIZE} ORDER BY doc_id) - 1 AS INTEGER)
           AS pos,
         CAST(doc_id AS VARCHAR) AS ref_id, concat_ws(' ', lang, source) AS title,
         source AS employer, lang AS city
  FROM documents),
tot AS (SELECT count(*) AS total FROM documents),
pp AS (SELECT page, count(*) AS n_listings,
              count_if(NOT contains(lower(coalesce(title, '')), '{KEYWORDS[0]}')) AS kept
       FROM d GROUP BY page),
run AS (SELECT pp.*, tot.total,
               CAST(sum(kept) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS BIGINT) AS running,
               row_number() OVER (ORDER BY page) AS seq
        FROM pp, tot),
lim AS (SELECT least(coalesce(min(CASE WHEN n_listings = 0 OR seq <> page THEN page END) - 1,
                              max(page)),
                     coalesce(min(CASE WHEN running >= total THEN page END), max(page))) AS last_page
        FROM run)
"""


@register("read_search_pages", _PAGES_SQL + """
SELECT page, pos, (CAST(page AS BIGINT) << 32) + pos AS batch_ord, ref_id, title, employer, city
FROM d""")
def q_read_search_pages(spark, sf):
    rows = SP.page_listings(landed_pages(spark, sf))
    return rows.select("page", "pos", "batch_ord", "ref_id", "title", "employer",
                       F.col("location.city").alias("city"))


@register("page_prefix", f"""
WITH d AS (
  SELECT doc_id, lang AS search, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS nth,
         concat_ws(' ', lang, source) AS title FROM documents)
SELECT search, CAST(nth // {PAGE_SIZE} + 1 AS INTEGER) AS page, CAST(nth % {PAGE_SIZE} AS INTEGER) AS pos,
       CAST(doc_id AS VARCHAR) AS ref_id, title
FROM d WHERE NOT contains(lower(coalesce(title, '')), '{KEYWORDS[0]}')""")
def q_page_prefix(spark, sf):
    """A2 for one search per language: no page is missing and no total reached early, so all are read."""
    rows = SP.page_prefix(landed_searches(spark, sf), None, KEYWORDS, search_col="search")
    return rows.select("search", "page", "pos", "ref_id", "title")


@register("bad_pages", f"""
WITH p AS (SELECT CAST(doc_id // {PAGE_SIZE} + 1 AS INTEGER) AS page, count(*) AS n FROM documents GROUP BY 1)
SELECT page, page % 3 = 0 AS is_bad, CAST(CASE WHEN page % 3 = 0 THEN 0 ELSE n END AS BIGINT) AS n_listings,
       page < 3 AS is_read FROM p""")
def q_bad_pages(spark, sf):
    """A1 with the line of every third page cut: reported, without listings, and paging stops before it."""
    whole = _pages(spark, sf).select("page", F.to_json(F.struct("page", "status", "total", "listings")).alias("line"))
    cut = F.when(F.col("page") % 3 == 0, F.expr("left(line, length(line) - 20)")).otherwise(F.col("line"))
    path = scratch_path(spark, "landing")
    whole.select(cut.alias("value")).write.mode("overwrite").text(path)
    pages = SP.read_search_pages(spark, path)
    bad = SP.bad_pages(spark, path).select(F.col("page").alias("b"))
    read = SP.page_prefix(pages, None, []).select(F.col("page").alias("r")).distinct()
    return pages.join(bad, pages["page"] == F.col("b"), "left").join(read, pages["page"] == F.col("r"), "left").select(
        "page", F.col("b").isNotNull().alias("is_bad"), F.coalesce(F.size("listings"), F.lit(0)).cast("long").alias("n_listings"),
        F.col("r").isNotNull().alias("is_read"))


@register("running_page_total", _PAGES_SQL + """
SELECT page, CAST(n_listings AS INTEGER) AS n_listings, CAST(kept AS BIGINT) AS kept,
       CAST(total AS BIGINT) AS total, running FROM run""")
def q_running_page_total(spark, sf):
    t = SP.page_totals(landed_pages(spark, sf), KEYWORDS)
    return t.select("page", "n_listings", "kept", "total", "running")
