"""Queries for the compositions (J11, J12, E14) and the sinks.

Binding: the landed search pages of ``q_pages`` (documents in pages of 100)
merged into a fresh store; for extraction, listings whose doc_id is not a
multiple of 5 point at page (doc_id mod number of pages) of `pages`.
"""

from pyspark.sql import functions as F

from listforge.operators import extract as X
from listforge.plans import bindings as B
from listforge.plans import gather as G
from listforge.plans import q_extract as QX
from listforge.plans import q_labels as QL
from listforge.plans import q_pages as QP
from listforge.plans.oracle import DOC_LISTINGS, LABELLED, with_ctes
from listforge.plans.registry import register
from listforge.session import scratch_path
from listforge.sources import sinks as SK
from listforge.sources import search_pages as SP

_SUMMARY_SQL = QP._PAGES_SQL + f""",
kept AS (SELECT d.* FROM d, lim
         WHERE page <= last_page AND NOT contains(lower(coalesce(title, '')), '{QP.KEYWORDS[0]}'))
SELECT CAST(count(*) AS BIGINT) AS total_found, CAST(count(*) AS BIGINT) AS total_scraped,
       CAST(count(*) AS BIGINT) AS extracted, CAST(0 AS BIGINT) AS failed,
       CAST(count(DISTINCT ref_id) AS BIGINT) AS new, CAST(0 AS BIGINT) AS updated,
       CAST(0 AS BIGINT) AS unchanged, CAST(count(DISTINCT ref_id) AS BIGINT) AS database_total
FROM kept"""


def _landing(spark, sf, with_urls: bool):
    pages = QP.landed_pages(spark, sf)
    if with_urls:
        html = B.table(spark, sf, "pages")
        n = html.count()
        urls = html.select(F.col("page_id").alias("_pid"), F.col("url"))
        lst = F.transform("listings", lambda x: x.withField("external_url", F.lit(None).cast("string")))
        pages = pages.withColumn("listings", lst)
        rows = SP.page_listings(pages).withColumn(
            "_pid", F.when(F.col("ref_id").cast("long") % 5 != 0, F.col("ref_id").cast("long") % n))
        rows = rows.join(urls, "_pid", "left")
        listing = F.struct("ref_id", "title", "employer", "location",
                           F.col("url").alias("external_url"), "modified_at", "published_on")
        pages = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(
            F.struct("pos", listing.alias("l")))), lambda x: x["l"]).alias("listings")).select(
            "page", F.lit(200).alias("status"),
            F.lit(str(B.table(spark, sf, "documents").count())).alias("total"), "listings")
    path = scratch_path(spark, "landing")
    pages.write.mode("overwrite").json(path)
    return path


@register("gather_summary", _SUMMARY_SQL)
def q_gather_summary(spark, sf):
    """E14 of a first gather without extraction into an empty store."""
    landing = _landing(spark, sf, with_urls=False)
    g = G.gather(spark, landing, scratch_path(spark, "store"), None, "q-docs", B.PLACE,
                 B.RADIUS_KM, B.AS_OF, B.INTERNAL_BASE_URL,
                 keywords=QP.KEYWORDS, enable_extraction=False)
    return g.summary.select("total_found", "total_scraped", "extracted", "failed", "new",
                            "updated", "unchanged", "database_total")


_KEPT_SQL = QX._LISTING_DETAILS + f""",
kept AS (SELECT n.* FROM listing_details n JOIN documents d USING (doc_id)
         WHERE NOT contains(lower(concat_ws(' ', d.lang, d.source)), '{QP.KEYWORDS[0]}'))"""


@register("gather", f"""
WITH {_KEPT_SQL}
SELECT count(*) AS total_found, count(*) AS total_scraped, CAST(count_if(success) AS BIGINT) AS extracted,
       CAST(count_if(NOT success) AS BIGINT) AS failed, count(DISTINCT doc_id) AS new, CAST(0 AS BIGINT) AS updated,
       CAST(0 AS BIGINT) AS unchanged, count(DISTINCT doc_id) AS database_total FROM kept""")
def q_gather(spark, sf):
    """J11 with extraction against the landed `pages` corpus."""
    landing = _landing(spark, sf, with_urls=True)
    g = G.gather(spark, landing, scratch_path(spark, "store"), B.table(spark, sf, "pages"),
                 "q-docs", B.PLACE, B.RADIUS_KM, B.AS_OF, B.INTERNAL_BASE_URL,
                 keywords=QP.KEYWORDS)
    return g.summary


@register("full_run", f"""
WITH {_KEPT_SQL},
prof AS (SELECT {QL._terms_sql('text')} AS p FROM benchmark WHERE item_id = 0),
share AS (SELECT CAST(len(list_intersect({QL._terms_sql('k.text')}, prof.p)) AS DOUBLE) / len(prof.p) AS s
          FROM kept k, prof WHERE k.success),
c AS (SELECT count(*) AS t, CAST(count_if(success) AS BIGINT) AS e FROM kept)
SELECT t AS total_found, e AS extracted, CAST(e AS DOUBLE) / t * 100.0 AS extract_rate, e AS labelled,
       CAST(e AS DOUBLE) / t * 100.0 AS label_rate, e AS returned, CAST(NULL AS DOUBLE) AS match_rate,
       t - e AS failures, CAST(t - e AS DOUBLE) / t * 100.0 AS failure_rate,
       (SELECT count(*) FROM share WHERE s >= 0.25) AS n_excellent_match,
       (SELECT count(*) FROM share WHERE s >= 0.12 AND s < 0.25) AS n_good_match,
       (SELECT count(*) FROM share WHERE s < 0.12) AS n_poor_match FROM c""")
def q_full_run(spark, sf):
    """Gather -> label -> dashboard."""
    from listforge.operators import labels as L
    from listforge.plans.q_labels import profile_text

    landing = _landing(spark, sf, with_urls=True)
    profile = profile_text(spark, sf)
    _rows, dash = G.full_run(spark, landing, scratch_path(spark, "store"),
                             scratch_path(spark, "runs"), B.table(spark, sf, "pages"), "q-docs",
                             B.PLACE, B.RADIUS_KM, B.AS_OF, B.INTERNAL_BASE_URL,
                             L.TermOverlapScorer(profile), profile, "full-run-q",
                             keywords=QP.KEYWORDS)
    return dash


@register("write_ranked_csv", with_ctes(DOC_LISTINGS, LABELLED) + """
SELECT title, city, employer, category AS categories, d_url AS url FROM labelled""")
def q_write_ranked_csv(spark, sf):
    """Ranked CSV of the labelled documents, read back."""
    lab = B.labelled_listings(spark, sf).withColumn("url", F.col("details.url"))
    path = scratch_path(spark, "csv")
    SK.write_ranked_csv(lab, path)
    return spark.read.option("header", True).schema(
        "title string, city string, employer string, categories string, url string").csv(path)


@register("write_failed_csv", with_ctes(DOC_LISTINGS) + f"""
SELECT coalesce(title, '') AS title, coalesce(city, '') AS city, coalesce(employer, '') AS employer,
       coalesce(d_url, '') AS url,
       CASE coalesce(d_warning, 'UNKNOWN') WHEN 'JS_REQUIRED' THEN 'JS_REQUIRED'
            WHEN 'SHORT_CONTENT' THEN 'SHORT_CONTENT' WHEN 'NO_CONTENT' THEN 'NO_CONTENT'
            WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'EXCEPTION' THEN 'EXCEPTION' ELSE 'ERROR' END
         AS error_type
FROM doc_listings WHERE NOT d_success""")
def q_write_failed_csv(spark, sf):
    """Failures CSV, read back."""
    _ok, failed = X.split_outcomes(B.doc_listings(spark, sf), B.INTERNAL_BASE_URL)
    path = scratch_path(spark, "csv")
    SK.write_failed_csv(failed, path)
    return spark.read.option("header", True).schema(
        "title string, city string, employer string, url string, error_type string").csv(path)


@register("write_json", with_ctes(DOC_LISTINGS, LABELLED) + """
SELECT ref_id, title, employer, category AS categories FROM labelled""")
def q_write_json(spark, sf):
    """Labelled rows as JSON, read back."""
    lab = B.labelled_listings(spark, sf).select("ref_id", "title", "employer", "categories")
    path = scratch_path(spark, "json")
    SK.write_json(lab, path)
    back = spark.read.schema(lab.schema).json(path)
    return back.withColumn("categories", F.array_join("categories", ", "))


@register("write_scraped", f"""
WITH {QX._DETAILS} SELECT 'run-a' AS run_id, page_id, success, method, warning FROM page_details""")
def q_write_scraped(spark, sf):
    """A10: extraction output of `pages` per run, read back."""
    out = X.extract_corpus(B.table(spark, sf, "pages"))
    path = scratch_path(spark, "scraped")
    SK.write_scraped(out, path, "run-a")
    return spark.read.parquet(path).select("run_id", "page_id", "details.success",
                                           "details.method", "details.warning")


@register("write_error_report", with_ctes(DOC_LISTINGS) + """
SELECT coalesce(d_warning, 'UNKNOWN') AS warning, CAST(count(*) AS BIGINT) AS failures
FROM doc_listings WHERE NOT d_success GROUP BY 1""")
def q_write_error_report(spark, sf):
    """Failure tables of the documents binding, read back (by warning)."""
    path = scratch_path(spark, "errors")
    written = SK.write_error_report(B.doc_listings(spark, sf), path)
    if not written:
        return spark.createDataFrame([], "warning string, failures long")
    return spark.read.schema("warning string, failures long").json(f"{path}/by_warning")
