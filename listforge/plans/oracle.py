"""DuckDB twins of the Spark bindings (same role rules as ``plans.bindings``)."""

from listforge import schemas as S
from listforge.plans import bindings as B

DOC_LISTINGS = f"""
doc_listings AS (
  SELECT doc_id AS ord,
         CAST(doc_id AS VARCHAR) AS ref_id,
         concat_ws(' ', lang, source) AS title,
         source AS employer,
         lang AS city,
         CASE WHEN doc_id % 5 = 0 THEN NULL
              ELSE 'https://' || source || '.example.org/jobs/' || CAST(doc_id AS VARCHAR) END
           AS external_url,
         n_chars >= {S.MIN_VALID_TEXT_LENGTH} AS d_success,
         text AS d_text,
         CASE WHEN doc_id % 5 = 0 THEN '{B.INTERNAL_BASE_URL}/' || CAST(doc_id AS VARCHAR)
              ELSE 'https://' || source || '.example.org/jobs/' || CAST(doc_id AS VARCHAR) END
           AS d_url,
         CASE WHEN doc_id % 5 = 0 THEN 'internal' ELSE 'external' END AS d_source,
         CASE WHEN n_chars >= {S.MIN_VALID_TEXT_LENGTH} THEN 'css_selector' ELSE 'fallback' END
           AS d_method,
         CAST(n_chars AS BIGINT) AS d_text_length,
         source AS d_domain,
         CASE WHEN n_chars >= {S.MIN_VALID_TEXT_LENGTH} THEN NULL ELSE 'SHORT_CONTENT' END
           AS d_warning,
         CASE WHEN n_chars >= {S.MIN_VALID_TEXT_LENGTH} THEN NULL
              ELSE 'Insufficient content (' || CAST(n_chars AS VARCHAR) || ' chars)' END AS d_error
  FROM documents
)"""

LABELLED = f"""
labelled AS (
  SELECT dl.*,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN '{S.CATEGORY_EXCELLENT}'
              WHEN l.quality = 1 THEN '{S.CATEGORY_GOOD}'
              ELSE '{S.CATEGORY_POOR}' END AS category
  FROM doc_listings dl JOIN labels l ON dl.ord = l.doc_id
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
