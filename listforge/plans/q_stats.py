"""Queries for extraction statistics (E5-E12, E22) on the documents binding."""


from listforge.operators import stats as ST
from listforge.plans import bindings as B
from listforge.plans.oracle import DOC_LISTINGS, with_ctes
from listforge.plans.registry import register

_DV = with_ctes(DOC_LISTINGS, """
dv AS (
  SELECT ord, coalesce(d_source, 'unknown') AS source, coalesce(d_success, false) AS success,
         coalesce(d_domain, 'unknown') AS domain, d_method AS method, d_warning AS warning,
         coalesce(d_text_length, length(coalesce(d_text, ''))) AS length_or_text,
         coalesce(d_text_length, 0) AS length_or_zero,
         title, external_url, ref_id, d_url, d_error
  FROM doc_listings
)""")

_DOMAIN_CORE = _DV + """,
ext AS (SELECT * FROM dv WHERE source = 'external'),
agg AS (
  SELECT domain, CAST(count(*) AS BIGINT) AS total,
         CAST(count_if(success) AS BIGINT) AS successful,
         CAST(count_if(NOT success) AS BIGINT) AS failed,
         CAST(floor(sum(length_or_zero) / count(*)) AS BIGINT) AS avg_text_length,
         CAST(min(length_or_zero) AS BIGINT) AS min_text_length,
         CAST(max(length_or_zero) AS BIGINT) AS max_text_length,
         min(ord) AS first_ord,
         CAST(count_if(success) AS DOUBLE) / count(*) * 100.0 AS rate_raw
  FROM ext GROUP BY domain
),
wc AS (SELECT domain, warning AS v, count(*) AS n, min(ord) AS f FROM ext
       WHERE coalesce(warning, '') <> '' GROUP BY 1, 2),
pw AS (SELECT domain, v AS primary_warning FROM (
         SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, f) AS rn FROM wc)
       WHERE rn = 1),
mc AS (SELECT domain, coalesce(method, 'unknown') AS v, count(*) AS n, min(ord) AS f FROM ext
       GROUP BY 1, 2),
pm AS (SELECT domain, v AS primary_method FROM (
         SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, f) AS rn FROM mc)
       WHERE rn = 1),
core AS (SELECT agg.*, pw.primary_warning, pm.primary_method
         FROM agg LEFT JOIN pw USING (domain) LEFT JOIN pm USING (domain))
"""


@register("stats_by_source", _DV + """
SELECT source, CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(success) AS BIGINT) AS successful,
       CAST(count_if(NOT success) AS BIGINT) AS failed,
       CAST(floor(sum(length_or_text) / count(*)) AS BIGINT) AS avg_text_length
FROM dv GROUP BY source""")
def q_stats_by_source(spark, sf):
    return ST.stats_by_source(B.doc_listings(spark, sf))


@register("stats_by_domain", _DOMAIN_CORE + """
SELECT domain, total, successful, failed, round(rate_raw, 1) AS success_rate,
       avg_text_length, min_text_length, max_text_length, primary_warning, primary_method
FROM core""")
def q_stats_by_domain(spark, sf):
    return ST.stats_by_domain(B.doc_listings(spark, sf))


@register("stats_by_method", _DV + """
SELECT method, CAST(count(*) AS BIGINT) AS n FROM dv
WHERE method IS NOT NULL AND method <> '' AND method <> 'unknown' GROUP BY method""")
def q_stats_by_method(spark, sf):
    return ST.stats_by_method(B.doc_listings(spark, sf))


@register("stats_by_warning", _DV + """
SELECT warning, CAST(count(*) AS BIGINT) AS n FROM dv
WHERE coalesce(warning, '') <> '' GROUP BY warning""")
def q_stats_by_warning(spark, sf):
    return ST.stats_by_warning(B.doc_listings(spark, sf))


@register("failures_by_warning", _DV + """
SELECT coalesce(warning, 'UNKNOWN') AS warning, CAST(count(*) AS BIGINT) AS failures
FROM dv WHERE NOT success GROUP BY 1""")
def q_failures_by_warning(spark, sf):
    return ST.failures_by_warning(B.doc_listings(spark, sf))


@register("failures_by_domain_top10", _DV + """
SELECT domain, failures FROM (
  SELECT domain, CAST(count(*) AS BIGINT) AS failures, min(ord) AS first_ord
  FROM dv WHERE NOT success GROUP BY domain)
ORDER BY failures DESC, first_ord LIMIT 10""")
def q_failures_by_domain_top10(spark, sf):
    return ST.failures_by_domain_top(B.doc_listings(spark, sf), 10)


@register("failure_details", _DV + """
SELECT ordinal, title, url, domain, error, warning FROM (
  SELECT CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS ordinal, success,
         coalesce(title, 'N/A') AS title,
         coalesce(d_url, external_url, 'refnr:' || coalesce(ref_id, 'None')) AS url,
         domain, coalesce(d_error, 'Unknown') AS error, coalesce(warning, 'UNKNOWN') AS warning
  FROM dv)
WHERE NOT success""")
def q_failure_details(spark, sf):
    return ST.failure_details(B.doc_listings(spark, sf))


@register("problem_domains", _DOMAIN_CORE + """
SELECT domain, total, round(rate_raw, 1) AS success_rate, primary_warning, first_ord
FROM core WHERE rate_raw < 50 AND total >= 3""")
def q_problem_domains(spark, sf):
    return ST.problem_domains(B.doc_listings(spark, sf))


@register("good_domains", _DOMAIN_CORE + """
SELECT domain, total, round(rate_raw, 1) AS success_rate, primary_method, first_ord
FROM core WHERE rate_raw >= 80 AND total >= 3""")
def q_good_domains(spark, sf):
    return ST.good_domains(B.doc_listings(spark, sf))


@register("extraction_report", _DOMAIN_CORE + """,
src AS (SELECT source, count(*) AS total, count_if(success) AS successful,
               CAST(floor(sum(length_or_text) / count(*)) AS BIGINT) AS avg_len FROM dv GROUP BY source),
meth AS (SELECT method, count(*) AS n FROM dv
         WHERE method IS NOT NULL AND method <> '' AND method <> 'unknown' GROUP BY method),
warn AS (SELECT warning, count(*) AS n FROM dv WHERE coalesce(warning, '') <> '' GROUP BY warning),
prob AS (SELECT domain, total, round(rate_raw, 1) AS success_rate, primary_warning FROM core
         WHERE rate_raw < 50 AND total >= 3 ORDER BY total DESC, first_ord LIMIT 5)
SELECT 'source' AS section, source AS item, CAST(successful AS BIGINT) AS n, CAST(total AS BIGINT) AS total,
       CASE WHEN total > 0 THEN CAST(successful AS DOUBLE) / total * 100.0 ELSE 0.0 END AS pct,
       avg_len AS avg_text_length, CAST(NULL AS VARCHAR) AS primary_warning
FROM src
UNION ALL
SELECT 'method', method, CAST(n AS BIGINT), CAST(sum(n) OVER () AS BIGINT),
       CAST(n AS DOUBLE) / sum(n) OVER () * 100.0, NULL, NULL FROM meth
UNION ALL
SELECT 'warning', warning, CAST(n AS BIGINT), NULL, CAST(NULL AS DOUBLE), NULL, NULL FROM warn
UNION ALL
SELECT 'problem_domain', domain, total, total, success_rate, NULL, primary_warning FROM prob""")
def q_extraction_report(spark, sf):
    return ST.extraction_report(B.doc_listings(spark, sf))


@register("primary_value", _DOMAIN_CORE + """
SELECT domain, primary_warning, primary_method FROM core""")
def q_primary_value(spark, sf):
    """most frequent warning and method per domain, first seen wins ties."""
    return ST.stats_by_domain(B.doc_listings(spark, sf)).select(
        "domain", "primary_warning", "primary_method")
