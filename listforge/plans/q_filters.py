"""Queries for projections, filters and scalar functions."""

from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.functions import columns as C
from listforge.operators import extract as X
from listforge.operators import filters as FL
from listforge.operators import stats as STS
from listforge.plans import bindings as B
from listforge.plans.oracle import DOC_LISTINGS, LABELLED, with_ctes
from listforge.plans.registry import register
from listforge.session import scratch_path
from listforge.sources import search_pages as SP

_DOC = with_ctes(DOC_LISTINGS)
_LAB = with_ctes(DOC_LISTINGS, LABELLED)
EXCLUDE = ["red", "bolt"]
SEARCH = "src1"


@register("flatten_listing", _DOC + """
SELECT coalesce(title, '') AS title, coalesce(city, '') AS city, coalesce(employer, '') AS employer,
       ref_id, external_url
FROM doc_listings""")
def q_flatten_listing(spark, sf):
    d = B.doc_listings(spark, sf).withColumn("modified_at", F.lit(None).cast("string")) \
        .withColumn("published_on", F.lit(None).cast("date"))
    return FL.flatten_listing(d).drop("modified_at", "published_on")


@register("exclude_keywords", f"""
SELECT p_partkey, p_name FROM part
WHERE NOT (contains(lower(coalesce(p_name, '')), '{EXCLUDE[0]}')
           OR contains(lower(coalesce(p_name, '')), '{EXCLUDE[1]}'))""")
def q_exclude_keywords(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", "p_name")
    return FL.exclude_keywords(p, EXCLUDE, title_col="p_name")


@register("published_within", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published_on FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - INTERVAL 100 DAY""")
def q_published_within(spark, sf):
    """Orders landed in folders by month; the filter prunes folders, then rows."""
    o = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("published_on"))
    path = scratch_path(spark, "by-date")
    SP.write_by_date(o, path, unit="MONTH")
    kept = FL.published_within(spark.read.parquet(path), "2001-08-01", 100, part_col=SP.PART, unit="MONTH")
    return kept.select("o_orderkey", F.date_format("published_on", "yyyy-MM-dd").alias("published_on"))


_REF_RULE = ("CASE WHEN n_chars < 100 THEN NULL WHEN n_chars < 200 THEN '' "
             "ELSE CAST(doc_id AS VARCHAR) END")


@register("require_ref", f"""
SELECT doc_id, ref_id FROM (SELECT doc_id, {_REF_RULE} AS ref_id FROM documents)
WHERE coalesce(ref_id, '') <> ''""")
def q_require_ref(spark, sf):
    """Documents as incoming rows whose ref is missing (< 100 chars) or empty (< 200)."""
    d = B.table(spark, sf, "documents")
    ref = (F.when(F.col("n_chars") < 100, F.lit(None).cast("string"))
           .when(F.col("n_chars") < 200, F.lit("")).otherwise(F.col("doc_id").cast("string")))
    return FL.require_ref(d.select("doc_id", ref.alias("ref_id")))


@register("route_source", _DOC + """
SELECT ref_id, CASE WHEN trim(coalesce(external_url, '')) <> '' THEN 'external'
                    WHEN coalesce(ref_id, '') <> '' THEN 'internal' ELSE 'none' END AS route
FROM doc_listings""")
def q_route_source(spark, sf):
    d = B.doc_listings(spark, sf)
    return d.select("ref_id", C.route_source("external_url", "ref_id").alias("route"))


@register("split_outcomes", _DOC + f"""
SELECT 'ok' AS outcome, ref_id, coalesce(title, '') AS title, coalesce(city, '') AS city,
       coalesce(employer, '') AS employer, d_text AS text, coalesce(d_url, '') AS url,
       CAST(NULL AS VARCHAR) AS error_type, CAST(NULL AS VARCHAR) AS error_details
FROM doc_listings WHERE coalesce(d_success, false)
UNION ALL
SELECT 'failed', ref_id, coalesce(title, ''), coalesce(city, ''), coalesce(employer, ''), NULL,
       CASE WHEN coalesce(nullif(d_url, ''), nullif(external_url, '')) IS NOT NULL
              THEN coalesce(nullif(d_url, ''), nullif(external_url, ''))
            WHEN coalesce(ref_id, '') <> '' THEN '{B.INTERNAL_BASE_URL}/' || ref_id ELSE '' END,
       CASE coalesce(d_warning, 'UNKNOWN') WHEN 'JS_REQUIRED' THEN 'JS_REQUIRED'
            WHEN 'SHORT_CONTENT' THEN 'SHORT_CONTENT' WHEN 'NO_CONTENT' THEN 'NO_CONTENT'
            WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'EXCEPTION' THEN 'EXCEPTION' ELSE 'ERROR' END,
       coalesce(d_error, 'Unknown error')
FROM doc_listings WHERE NOT coalesce(d_success, false)""")
def q_split_outcomes(spark, sf):
    """The OK and FAILED projections of one extracted input, stacked with ``outcome``."""
    ok, failed = X.split_outcomes(B.doc_listings(spark, sf), B.INTERNAL_BASE_URL)
    none = F.lit(None).cast("string")
    a = ok.select(F.lit("ok").alias("outcome"), "ref_id", "title", "city", "employer", "text", "url",
                  none.alias("error_type"), none.alias("error_details"))
    b = failed.select(F.lit("failed").alias("outcome"), "ref_id", "title", "city", "employer",
                      none.alias("text"), "url", "error_type", "error_details")
    return a.unionByName(b)


_RESOLVE_SQL = f"""
SELECT ref_id,
       CASE WHEN coalesce(nullif(u, ''), nullif(external_url, '')) IS NOT NULL
              THEN coalesce(nullif(u, ''), nullif(external_url, ''))
            WHEN coalesce(ref_id, '') <> '' THEN '{B.INTERNAL_BASE_URL}/' || ref_id ELSE '' END AS url
FROM (SELECT ref_id, external_url,
             CASE WHEN CAST(ref_id AS BIGINT) % 2 = 0 THEN d_url END AS u
      FROM doc_listings WHERE NOT coalesce(d_success, false))"""


@register("resolve_url", _DOC + _RESOLVE_SQL)
def q_resolve_url(spark, sf):
    """B8 on failed rows; every other row lost its details url, so both fallbacks are used."""
    d = B.doc_listings(spark, sf).where(~F.coalesce(F.col("details.success"), F.lit(False)))
    d = d.withColumn("details", F.col("details").withField(
        "url", F.when(F.col("ord") % 2 == 0, F.col("details.url"))))
    return d.select("ref_id", X.resolve_failed_url(B.INTERNAL_BASE_URL).alias("url"))


_WARNINGS_SQL = """
SELECT ord, CASE ord % 9 WHEN 0 THEN NULL WHEN 1 THEN 'JS_REQUIRED' WHEN 2 THEN 'SHORT_CONTENT'
  WHEN 3 THEN 'NO_CONTENT' WHEN 4 THEN 'TIMEOUT' WHEN 5 THEN 'EXCEPTION' WHEN 6 THEN 'LOW_QUALITY'
  WHEN 7 THEN 'EXCESSIVE_CONTENT' ELSE 'UNKNOWN' END AS warning FROM doc_listings"""


@register("error_type", _DOC + f"""
SELECT ord, warning,
       CASE coalesce(warning, 'UNKNOWN') WHEN 'JS_REQUIRED' THEN 'JS_REQUIRED'
            WHEN 'SHORT_CONTENT' THEN 'SHORT_CONTENT' WHEN 'NO_CONTENT' THEN 'NO_CONTENT'
            WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'EXCEPTION' THEN 'EXCEPTION' ELSE 'ERROR' END
         AS error_type
FROM ({_WARNINGS_SQL})""")
def q_error_type(spark, sf):
    """Every warning code (and a missing one) assigned round-robin over the listings."""
    d = B.doc_listings(spark, sf)
    codes = [None, "JS_REQUIRED", "SHORT_CONTENT", "NO_CONTENT", "TIMEOUT", "EXCEPTION",
             "LOW_QUALITY", "EXCESSIVE_CONTENT", "UNKNOWN"]
    arr = F.array(*[F.lit(c).cast("string") for c in codes])
    w = F.element_at(arr, (F.col("ord") % len(codes) + 1).cast("int"))
    return d.select("ord", w.alias("warning")).select("ord", "warning",
                                                     C.error_type("warning").alias("error_type"))


@register("matches_only", _LAB + """
SELECT ref_id, category FROM labelled WHERE category IN ('Excellent Match', 'Good Match')""")
def q_matches_only(spark, sf):
    lab = B.labelled_listings(spark, sf)
    return FL.matches_only(lab).select("ref_id", F.element_at("categories", 1).alias("category"))


@register("text_search", _LAB + f"""
SELECT ref_id, title, city, employer, category FROM labelled
WHERE contains(lower(ref_id), '{SEARCH}') OR contains(lower(title), '{SEARCH}')
   OR contains(lower(city), '{SEARCH}') OR contains(lower(employer), '{SEARCH}')
   OR contains(lower(category), '{SEARCH}')""")
def q_text_search(spark, sf):
    lab = B.labelled_listings(spark, sf).select(
        "ref_id", "title", F.col("location.city").alias("city"), "employer",
        F.array_join("categories", ", ").alias("category"))
    return FL.text_search(lab, "  SRC1 ", ["ref_id", "title", "city", "employer", "category"])


@register("category_filter", _LAB + """
SELECT ref_id, category AS display_category FROM labelled WHERE category = 'Good Match'""")
def q_category_filter(spark, sf):
    lab = STS.with_display_category(B.labelled_listings(spark, sf))
    return FL.category_filter(lab, S.CATEGORY_GOOD).select("ref_id", "display_category")


@register("size_guard", f"""
SELECT CAST(doc_id AS VARCHAR) AS ref_id, CAST(length(text) AS BIGINT) AS length,
       CAST({S.MAX_TEXT_CHARS} AS BIGINT) AS "limit",
       CAST(length(text) - {S.MAX_TEXT_CHARS} AS BIGINT) AS loss
FROM documents WHERE length(coalesce(text, '')) > {S.MAX_TEXT_CHARS}""")
def q_size_guard(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("ref_id"), "text")
    return FL.size_guard(d)


@register("slug", _LAB + """
SELECT ref_id, replace(replace(replace(lower(category), ' ', ''), '_', ''), '-', '') AS slug,
       replace(replace(replace(lower(title), ' ', ''), '_', ''), '-', '') AS title_slug
FROM labelled""")
def q_slug(spark, sf):
    lab = B.labelled_listings(spark, sf)
    return lab.select("ref_id", C.slug(F.element_at("categories", 1)).alias("slug"),
                      C.slug("title").alias("title_slug"))


@register("detail_url", _DOC + f"""
SELECT ref_id, '{B.INTERNAL_BASE_URL}/' || ref_id AS url FROM doc_listings""")
def q_detail_url(spark, sf):
    d = B.doc_listings(spark, sf)
    return d.select("ref_id", C.detail_url(B.INTERNAL_BASE_URL, F.col("ref_id")).alias("url"))


@register("run_timestamp", """
SELECT event_id, run_id, regexp_full_match(run_id, '[0-9]{8}_[0-9]{6}') AS valid,
       strftime(strptime(run_id, '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS run_ts,
       regexp_full_match(replace(run_id, '_', '-'), '[0-9]{8}_[0-9]{6}') AS dashed_valid
FROM (SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM events)""")
def q_run_timestamp(spark, sf):
    """Run ids from event times, parsed back; a dashed variant never validates."""
    e = B.table(spark, sf, "events").select("event_id", C.run_id_of("ts").alias("run_id"))
    return e.select(
        "event_id", "run_id", C.run_id_valid("run_id").alias("valid"),
        F.date_format(C.run_id_timestamp("run_id"), "yyyy-MM-dd HH:mm:ss").alias("run_ts"),
        C.run_id_valid(F.regexp_replace("run_id", "_", "-")).alias("dashed_valid"),
    )
