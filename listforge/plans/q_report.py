"""Queries for category statistics, rankings and the report (E1-E4, E17, E18, E20, F4,
G1-G4, J13).

Binding: found = all document listings; extracted = those with success;
labelled = extracted-or-not documents that carry a label (documents joined with
labels); returned = the matches among them (filtered run).
"""

from pyspark.sql import functions as F

from listforge.functions import columns as C
from listforge.operators import extract as X
from listforge.operators import filters as FL
from listforge.operators import report as RP
from listforge.operators import stats as ST
from listforge.plans import bindings as B
from listforge.plans.oracle import DOC_LISTINGS, LABELLED, with_ctes
from listforge.plans.registry import register

_LAB = with_ctes(DOC_LISTINGS, LABELLED) + """,
counts AS (SELECT category, CAST(count(*) AS BIGINT) AS n, min(ord) AS first_ord
           FROM labelled GROUP BY category),
matches AS (SELECT * FROM labelled WHERE category IN ('Excellent Match', 'Good Match'))
"""


def _frames(spark, sf):
    docs = B.doc_listings(spark, sf)
    extracted = docs.where(F.col("details.success"))
    labelled = B.labelled_listings(spark, sf)
    returned = FL.matches_only(labelled)
    return docs, extracted, labelled, returned


@register("category_counts", _LAB + "SELECT category, n, first_ord FROM counts")
def q_category_counts(spark, sf):
    return ST.category_counts(B.labelled_listings(spark, sf))


@register("category_percentages", _LAB + """
SELECT category, n, CASE WHEN t > 0 THEN CAST(n AS DOUBLE) / t * 100.0 ELSE 0.0 END AS pct
FROM counts, (SELECT count(*) AS t FROM doc_listings)""")
def q_category_percentages(spark, sf):
    docs, _e, labelled, _r = _frames(spark, sf)
    total = docs.count()
    return ST.category_percentages(ST.category_counts(labelled), total).drop("first_ord")


@register("basic_statistics", _LAB + """
SELECT category, n, first_ord,
       CASE WHEN t > 0 THEN CAST(n AS DOUBLE) / t * 100.0 ELSE 0.0 END AS pct,
       CASE WHEN t > 0 THEN CAST(s AS DOUBLE) / t * 100.0 ELSE 0.0 END AS coverage
FROM counts, (SELECT count(*) AS t, count_if(d_success) AS s FROM doc_listings)""")
def q_basic_statistics(spark, sf):
    docs, extracted, labelled, _r = _frames(spark, sf)
    return RP.basic_statistics(labelled, docs.count(), extracted.count())


@register("run_dashboard", _LAB + """,
c AS (SELECT (SELECT count(*) FROM doc_listings) AS t,
             (SELECT count(*) FROM doc_listings WHERE d_success) AS e,
             (SELECT count(*) FROM labelled) AS l, (SELECT count(*) FROM matches) AS r)
SELECT CAST(t AS BIGINT) AS total_found, CAST(e AS BIGINT) AS extracted,
       CASE WHEN t > 0 THEN CAST(e AS DOUBLE) / t * 100.0 ELSE 0.0 END AS extract_rate,
       CAST(l AS BIGINT) AS labelled,
       CASE WHEN t > 0 THEN CAST(l AS DOUBLE) / t * 100.0 ELSE 0.0 END AS label_rate,
       CAST(r AS BIGINT) AS returned,
       CASE WHEN l > r THEN (CASE WHEN l > 0 THEN CAST(r AS DOUBLE) / l * 100.0 ELSE 0.0 END) END
         AS match_rate,
       CAST(t - e AS BIGINT) AS failures,
       CASE WHEN t > 0 THEN CAST(t - e AS DOUBLE) / t * 100.0 ELSE 0.0 END AS failure_rate,
       (SELECT count(*) FROM matches WHERE category = 'Excellent Match') AS n_excellent_match,
       (SELECT count(*) FROM matches WHERE category = 'Good Match') AS n_good_match,
       (SELECT count(*) FROM matches WHERE category = 'Poor Match') AS n_poor_match
FROM c""")
def q_run_dashboard(spark, sf):
    docs, _e, labelled, _r = _frames(spark, sf)
    return RP.run_dashboard(docs, F.col("details.success"), labelled, C.is_match("categories"))


@register("run_summary", _LAB + """,
c AS (SELECT (SELECT count(*) FROM doc_listings) AS t,
             (SELECT count(*) FROM doc_listings WHERE d_success) AS e,
             (SELECT count(*) FROM matches) AS r,
             (SELECT count(*) FROM matches WHERE category = 'Excellent Match') AS ex,
             (SELECT count(*) FROM matches WHERE category = 'Good Match') AS go,
             (SELECT count(*) FROM matches WHERE category = 'Poor Match') AS po)
SELECT CAST(t AS BIGINT) AS total, CAST(e AS BIGINT) AS extracted,
       CASE WHEN t > 0 THEN CAST(e AS DOUBLE) / t * 100.0 ELSE 0.0 END AS extracted_pct,
       CAST(r AS BIGINT) AS returned,
       CASE WHEN t > 0 THEN CAST(r AS DOUBLE) / t * 100.0 ELSE 0.0 END AS returned_pct,
       CASE WHEN r > 0 THEN CAST(ex AS DOUBLE) / r * 100.0 ELSE 0.0 END AS excellent_match_pct,
       CASE WHEN r > 0 THEN CAST(go AS DOUBLE) / r * 100.0 ELSE 0.0 END AS good_match_pct,
       CASE WHEN r > 0 THEN CAST(po AS DOUBLE) / r * 100.0 ELSE 0.0 END AS poor_match_pct
FROM c""")
def q_run_summary(spark, sf):
    docs, _e, _l, returned = _frames(spark, sf)
    return RP.run_summary(docs, F.col("details.success"), returned)


@register("display_groups", _LAB + """
SELECT category AS display_category, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY 1""")
def q_display_groups(spark, sf):
    return ST.display_groups(B.labelled_listings(spark, sf))


@register("failures_by_error_type", with_ctes(DOC_LISTINGS) + """,
f AS (SELECT ref_id, CASE coalesce(d_warning, 'UNKNOWN') WHEN 'JS_REQUIRED' THEN 'JS_REQUIRED'
            WHEN 'SHORT_CONTENT' THEN 'SHORT_CONTENT' WHEN 'NO_CONTENT' THEN 'NO_CONTENT'
            WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'EXCEPTION' THEN 'EXCEPTION' ELSE 'ERROR' END
            AS error_type
      FROM doc_listings WHERE NOT d_success)
SELECT ref_id, error_type, CAST(count(*) OVER (PARTITION BY error_type) AS BIGINT) AS group_size
FROM f""")
def q_failures_by_error_type(spark, sf):
    _ok, failed = X.split_outcomes(B.doc_listings(spark, sf), B.INTERNAL_BASE_URL)
    return ST.failures_by_error_type(failed).select("ref_id", "error_type", "group_size")


@register("top_examples", _LAB + """,
top AS (SELECT category, n AS category_n, first_ord FROM counts
        ORDER BY n DESC, first_ord LIMIT 3),
ex AS (SELECT l.category, l.ord, l.title, l.city, l.employer,
              CAST(row_number() OVER (PARTITION BY l.category ORDER BY l.ord) AS INTEGER) AS example_no
       FROM labelled l WHERE l.category IN (SELECT category FROM top))
SELECT ex.category, ex.ord, ex.title, ex.city, ex.employer, ex.example_no, top.category_n,
       top.first_ord
FROM ex JOIN top USING (category) WHERE example_no <= 3""")
def q_top_examples(spark, sf):
    return RP.top_examples(B.labelled_listings(spark, sf), 3, 3).select(
        "category", "ord", "title", "city", "employer", "example_no", "category_n", "first_ord")


@register("rank_listings", _LAB + """
SELECT ref_id, title, category,
       CAST(row_number() OVER (ORDER BY CASE category WHEN 'Excellent Match' THEN 0
                                     WHEN 'Good Match' THEN 1 WHEN 'Poor Match' THEN 2 ELSE 999 END,
                               lower(title), ord) AS BIGINT) AS rank
FROM labelled""")
def q_rank_listings(spark, sf):
    ranked = RP.rank_listings(B.labelled_listings(spark, sf))
    return ranked.select("ref_id", "title", F.array_join("categories", ", ").alias("category"),
                         "rank")


@register("categories_by_count", _LAB + """
SELECT category, n, CAST(row_number() OVER (ORDER BY n DESC, first_ord) AS BIGINT) AS rank
FROM counts""")
def q_categories_by_count(spark, sf):
    return RP.categories_by_count(B.labelled_listings(spark, sf)).select("category", "n", "rank")


@register("sources_by_rank", with_ctes(DOC_LISTINGS) + """
SELECT method, n, CAST(row_number() OVER (ORDER BY n DESC, method) AS BIGINT) AS rank
FROM (SELECT d_method AS method, CAST(count(*) AS BIGINT) AS n FROM doc_listings
      WHERE d_method IS NOT NULL AND d_method <> '' AND d_method <> 'unknown' GROUP BY 1)""")
def q_sources_by_rank(spark, sf):
    return RP.ranked_counts(ST.stats_by_method(B.doc_listings(spark, sf)), "method")


@register("top_k", _LAB + """
SELECT category, n FROM counts ORDER BY n DESC, first_ord LIMIT 3""")
def q_top_k(spark, sf):
    return RP.top_categories(B.labelled_listings(spark, sf), 3).select("category", "n")


def _market_sql() -> str:
    from listforge.plans.q_stats import _DOMAIN_CORE

    return _DOMAIN_CORE + "," + LABELLED.strip() + """,
matches AS (SELECT * FROM labelled WHERE category IN ('Excellent Match', 'Good Match')),
c AS (SELECT (SELECT count(*) FROM doc_listings) AS t,
             (SELECT count(*) FROM doc_listings WHERE d_success) AS e,
             (SELECT count(*) FROM labelled) AS l, (SELECT count(*) FROM matches) AS r),
totals AS (
  SELECT 0 AS ord, 'total_found' AS key, t AS n, CAST(NULL AS DOUBLE) AS value FROM c UNION ALL
  SELECT 1, 'extracted', e, CASE WHEN t > 0 THEN CAST(e AS DOUBLE) / t * 100.0 ELSE 0.0 END FROM c UNION ALL
  SELECT 2, 'labelled', l, CASE WHEN t > 0 THEN CAST(l AS DOUBLE) / t * 100.0 ELSE 0.0 END FROM c UNION ALL
  SELECT 3, 'returned', r, CASE WHEN l > r THEN CAST(r AS DOUBLE) / l * 100.0 END FROM c UNION ALL
  SELECT 4, 'failures', t - e, CASE WHEN t > 0 THEN CAST(t - e AS DOUBLE) / t * 100.0 ELSE 0.0 END FROM c),
src AS (SELECT source, count(*) AS total, count_if(success) AS successful FROM dv GROUP BY source),
meth AS (SELECT method, count(*) AS n FROM dv
         WHERE method IS NOT NULL AND method <> '' AND method <> 'unknown' GROUP BY method),
warn AS (SELECT warning, count(*) AS n FROM dv WHERE coalesce(warning, '') <> '' GROUP BY warning),
prob AS (SELECT domain, total, round(rate_raw, 1) AS rate, primary_warning FROM core
         WHERE rate_raw < 50 AND total >= 3 ORDER BY total DESC, first_ord LIMIT 5),
extraction AS (
  SELECT 'source:' || source AS key, successful AS n, CAST(successful AS DOUBLE) / total * 100.0 AS value,
         CAST(NULL AS VARCHAR) AS detail FROM src UNION ALL
  SELECT 'method:' || method, n, CAST(n AS DOUBLE) / sum(n) OVER () * 100.0, NULL FROM meth UNION ALL
  SELECT 'warning:' || warning, n, NULL, NULL FROM warn UNION ALL
  SELECT 'problem_domain:' || domain, total, rate, primary_warning FROM prob),
mcounts AS (SELECT category, count(*) AS n, min(ord) AS first_ord FROM matches GROUP BY category),
top AS (SELECT category FROM mcounts ORDER BY n DESC, first_ord LIMIT 3),
ex AS (SELECT category, title, city, employer, d_url,
              row_number() OVER (PARTITION BY category ORDER BY ord) AS example_no
       FROM matches WHERE category IN (SELECT category FROM top))
SELECT 'totals' AS section, CAST(ord AS BIGINT) AS ord, key, CAST(n AS BIGINT) AS n, value,
       CAST(NULL AS VARCHAR) AS detail FROM totals
UNION ALL
SELECT 'extraction', 0, key, CAST(n AS BIGINT), value, detail FROM extraction
UNION ALL
SELECT 'categories', first_ord, category, n,
       CASE WHEN t > 0 THEN CAST(n AS DOUBLE) / t * 100.0 ELSE 0.0 END, NULL
FROM mcounts, (SELECT count(*) AS t FROM doc_listings)
UNION ALL
SELECT 'examples', example_no,
       category || ': ' || coalesce(title, 'N/A') || ' (' || coalesce(city, 'N/A') || ')', NULL, NULL,
       coalesce(employer, 'N/A') || ' | ' || coalesce(d_url, 'N/A')
FROM ex WHERE example_no <= 3"""


@register("market_report", _market_sql())
def q_market_report(spark, sf):
    """Report rows (totals, extraction, categories, examples)."""
    docs, _e, labelled, _r = _frames(spark, sf)
    return RP.market_report(docs, labelled, C.is_match("categories"))
