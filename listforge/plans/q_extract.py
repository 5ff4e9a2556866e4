"""Queries for text extraction (X1-X12) on `pages` and `documents`."""

from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.functions import columns as C
from listforge.operators import extract as X
from listforge.plans import bindings as B
from listforge.plans import sql_text as Q
from listforge.plans.registry import register
from listforge.session import scratch_path
from listforge.sources.pages import load_html_corpus

WS = S.PY_WHITESPACE_CLASS

_ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
_MAIN_TEXT = Q.clean(Q.decode_entities(Q.tags_to_space(_ARTICLE)))


def _body_sql() -> str:
    body = "substr(html, strpos(html, '<body'))"
    b = f"regexp_replace({body}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in S.REMOVE_TAGS:
        b = Q.drop_element(b, tag)
    return Q.clean(Q.decode_entities(Q.tags_to_space(b)))


_BODY_TEXT = _body_sql()


def _pieces(expr: str) -> str:
    """The strings between tags, trimmed, without empty ones, joined by one blank."""
    return (f"array_to_string(list_filter(list_transform(string_split_regex({expr}, '<[^>]*>'), "
            f"lambda x: regexp_replace({Q.decode_entities('x')}, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''), ' ')")


# X8 on the corpus: a paragraph that opens with <b> is never closed, so it runs to the end of
# the article and holds the later ones; the others end at their </p>
_PARAGRAPHS = f"""
paras AS (
  SELECT page_id, {Q.clean("array_to_string(list_filter(ps, lambda x: length(x) > " + str(S.MIN_PARAGRAPH_LENGTH) + "), ' ')")} AS para_text
  FROM (SELECT page_id, list_transform(range(2, len(segs) + 1), lambda i:
                 CASE WHEN starts_with(segs[i], '<b>') THEN {_pieces("array_to_string(segs[i:], '<p>')")}
                      ELSE {_pieces("split_part(segs[i], '</p>', 1)")} END) AS ps
        FROM (SELECT page_id, string_split({_ARTICLE}, '<p>') AS segs FROM pages)))"""
# X11 on the corpus: no structured data, no main element, only short divs
_LEAST = S.MIN_VALID_TEXT_LENGTH
_DETAILS = f"""{_PARAGRAPHS},
tiers AS (SELECT page_id, url, {Q.domain('url')} AS domain, {_MAIN_TEXT} AS m, para_text AS p, {_BODY_TEXT} AS b
          FROM pages JOIN paras USING (page_id)),
decided AS (SELECT *, CASE WHEN length(m) >= {_LEAST} THEN 'main'
                           WHEN length(m) > 0 AND length(m) < 500 AND contains(lower(m), 'javascript') THEN 'js'
                           WHEN length(p) >= {_LEAST} THEN 'paras' ELSE 'body' END AS tier FROM tiers),
page_details AS (
  SELECT page_id, url, tier IN ('main', 'paras') AS success,
         CASE tier WHEN 'paras' THEN p WHEN 'body' THEN b ELSE m END AS text, 'external' AS source,
         CASE tier WHEN 'paras' THEN 'paragraph_aggregation' WHEN 'body' THEN 'fallback' ELSE 'css_selector' END AS method,
         CAST(length(CASE tier WHEN 'paras' THEN p WHEN 'body' THEN b ELSE m END) AS BIGINT) AS text_length, domain,
         CASE WHEN tier = 'js' THEN 'JS_REQUIRED' WHEN tier = 'body' THEN
              CASE WHEN length(b) > 0 AND length(b) < 500 AND contains(lower(b), 'javascript') THEN 'JS_REQUIRED'
                   WHEN length(b) < {_LEAST} THEN 'SHORT_CONTENT' ELSE 'LOW_QUALITY' END END AS warning,
         CASE WHEN tier = 'js' THEN 'JavaScript required' WHEN tier = 'body' THEN
              'Insufficient content (' || CAST(length(b) AS VARCHAR) || ' chars)' END AS error
  FROM decided)"""
# Documents as listings; the newest page of a URL counts; internal pages have not landed
_LISTING_DETAILS = f"""{_DETAILS},
newest AS (SELECT * FROM page_details WHERE page_id IN (SELECT max(page_id) FROM pages GROUP BY url)),
listed AS (SELECT d.*, p.url AS external_url
           FROM documents d LEFT JOIN pages p ON d.doc_id % 5 <> 0 AND p.page_id = d.doc_id % (SELECT count(*) FROM pages)),
listing_details AS (
  SELECT l.doc_id, l.external_url, coalesce(n.success, false) AS success, n.text,
         CASE WHEN l.external_url IS NULL THEN 'internal' ELSE 'external' END AS source, n.method,
         CASE WHEN n.url IS NULL THEN 'EXCEPTION' ELSE n.warning END AS warning, coalesce(n.text_length, 0) AS text_length
  FROM listed l LEFT JOIN newest n ON n.url = l.external_url)"""


@register("clean_text", f"""
SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')) AS text_clean,
       CAST(length(trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))) AS BIGINT)
         AS clean_length
FROM documents""")
def q_clean_text(spark, sf):
    d = B.table(spark, sf, "documents")
    cleaned = C.clean_text("text")
    return d.select("doc_id", cleaned.alias("text_clean"),
                    F.length(cleaned).cast("long").alias("clean_length"))


@register("url_domain", f"""
SELECT page_id, url, {Q.domain('url')} AS domain FROM pages""")
def q_url_domain(spark, sf):
    p = B.table(spark, sf, "pages")
    return p.select("page_id", "url", C.url_domain("url").alias("domain"))


_JS_TEXT_SQL = ("CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' JavaScript' "
                "ELSE coalesce(text, '') END")


@register("needs_javascript", f"""
SELECT doc_id,
       CAST(length({_JS_TEXT_SQL}) AS BIGINT) AS probe_length,
       (length({_JS_TEXT_SQL}) > 0 AND length({_JS_TEXT_SQL}) < 500
        AND contains(lower({_JS_TEXT_SQL}), 'javascript')) AS needs_js
FROM documents""")
def q_needs_javascript(spark, sf):
    """X3 on whole document texts; every third document mentions JavaScript at its end."""
    d = B.table(spark, sf, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    probe = F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit(" JavaScript"))).otherwise(text)
    return d.select("doc_id", F.length(probe).cast("long").alias("probe_length"),
                    C.needs_javascript(probe).alias("needs_js"))


@register("strip_boilerplate", f"""
SELECT page_id, {_BODY_TEXT} AS body_text FROM pages""")
def q_strip_boilerplate(spark, sf):
    """Page text after removing boilerplate tags and class-matched elements."""
    return X.fallback_outcome(B.table(spark, sf, "pages")).select("page_id", "body_text")


@register("main_content", f"""
SELECT page_id, {Q.domain('url')} AS domain, {_MAIN_TEXT} AS main_text,
       CAST(length({_MAIN_TEXT}) AS BIGINT) AS main_length,
       length({_MAIN_TEXT}) >= {S.MIN_VALID_TEXT_LENGTH} AS main_ok,
       (length({_MAIN_TEXT}) > 0 AND length({_MAIN_TEXT}) < 500
        AND contains(lower({_MAIN_TEXT}), 'javascript')) AS main_js
FROM pages""")
def q_main_content(spark, sf):
    """Main-content element text for every page."""
    return X.main_content(B.table(spark, sf, "pages"))


@register("fallback_outcome", f"""
SELECT page_id, CAST(length({_BODY_TEXT}) AS BIGINT) AS body_length,
       CASE WHEN length({_BODY_TEXT}) > 0 AND length({_BODY_TEXT}) < 500
                 AND contains(lower({_BODY_TEXT}), 'javascript') THEN 'JS_REQUIRED'
            WHEN length({_BODY_TEXT}) < {S.MIN_VALID_TEXT_LENGTH} THEN 'SHORT_CONTENT'
            ELSE 'LOW_QUALITY' END AS warning,
       'Insufficient content (' || CAST(length({_BODY_TEXT}) AS VARCHAR) || ' chars)' AS error
FROM pages""")
def q_fallback_outcome(spark, sf):
    """Fallback body text length, warning and error for every page."""
    return X.fallback_outcome(B.table(spark, sf, "pages")).select(
        "page_id", "body_length", "warning", "error")


@register("extract_corpus", f"""
WITH {_DETAILS}
SELECT page_id, url, success AS d_success, text AS d_text, url AS d_url, source AS d_source, method AS d_method,
       text_length AS d_text_length, domain AS d_domain, warning AS d_warning, error AS d_error FROM page_details""")
def q_extract_corpus(spark, sf):
    """X11: the full cascade over every page."""
    out = X.extract_corpus(B.table(spark, sf, "pages"))
    return out.select("page_id", "url", *[F.col(f"details.{f.name}").alias(f"d_{f.name}") for f in S.DETAILS.fields])


@register("extract_listings", f"""
WITH {_LISTING_DETAILS}
SELECT CAST(doc_id AS VARCHAR) AS ref_id, doc_id AS batch_ord, external_url, success, source, method, warning,
       CAST(text_length AS BIGINT) AS text_length FROM listing_details""")
def q_extract_listings(spark, sf):
    """Listings routed to landed pages (documents as listings, pages as landed HTML).

    Listing i points at page i % n_pages through its external URL; every fifth
    document is routed to the internal detail page, which has not landed.
    """
    docs = B.table(spark, sf, "documents")
    pages = B.table(spark, sf, "pages")
    n_pages = pages.count()
    listings = docs.select(
        F.col("doc_id").cast("string").alias("ref_id"),
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.col("source").alias("employer"),
        F.struct(F.col("lang").alias("city")).alias("location"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % F.lit(n_pages)).alias("_pid"),
        F.col("doc_id").alias("batch_ord"),
    )
    urls = pages.select(F.col("page_id").alias("_pid"), F.col("url").alias("external_url"))
    listings = listings.join(urls, "_pid", "left").drop("_pid")
    out = X.extract_listings(listings, pages, B.INTERNAL_BASE_URL)
    return out.select("ref_id", "batch_ord", "external_url", "details.success", "details.source",
                      "details.method", "details.warning", "details.text_length")


_STRIPPED = f"regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g')"


def _escaped(col):
    return F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@register("extract_json_ld", f"""
SELECT doc_id AS page_id, CASE WHEN ok THEN {Q.clean('text')} END AS tier_text,
       CASE WHEN ok THEN CAST(length({Q.clean('text')}) AS BIGINT) END AS tier_length,
       ok AND length({Q.clean('text')}) >= {S.MIN_VALID_TEXT_LENGTH} AS tier_ok
FROM (SELECT *, doc_id % 4 <> 2 AND coalesce(length(text), 0) >= {S.MIN_VALID_TEXT_LENGTH} AS ok FROM documents)""")
def q_extract_json_ld(spark, sf):
    """X4 on pages built from whole documents: an object, a list with another type before it,
    a broken block before it (the tier ends), a second block after one of another type."""
    d = B.table(spark, sf, "documents")
    posting = F.struct(F.lit("JobPosting").alias("@type"), F.col("text").alias("description"))
    other = F.struct(F.lit("Organization").alias("@type"), F.lit("x").alias("description"))

    def block(body):
        return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))

    one = block(F.to_json(posting))
    kind = F.col("doc_id") % 4
    head = (F.when(kind == 0, one).when(kind == 1, block(F.to_json(F.array(other, posting))))
            .when(kind == 2, F.concat(block(F.lit("{bad")), one)).otherwise(F.concat(block(F.to_json(other)), one)))
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body><main>short</main></body></html>"))
    return X.tier_text(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), "json_ld")


_DIV_SQL = "CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || chr(10) || 'tail' ELSE coalesce(text, '') END"


@register("heaviest_div", f"""
SELECT doc_id AS page_id, CASE WHEN ok THEN {Q.clean(_DIV_SQL)} END AS tier_text,
       CASE WHEN ok THEN CAST(length({Q.clean(_DIV_SQL)}) AS BIGINT) END AS tier_length,
       ok AND length({Q.clean(_DIV_SQL)}) >= {S.MIN_VALID_TEXT_LENGTH} AS tier_ok
FROM (SELECT *, length({_STRIPPED}) + CASE WHEN doc_id % 2 = 1 THEN 0 WHEN length({_STRIPPED}) > 0 THEN 5 ELSE 4 END
              >= {S.MIN_VALID_TEXT_LENGTH} AS ok FROM documents)""")
def q_heaviest_div(spark, sf):
    """X7 on pages built from whole documents: even ids in a nested div with a tail (the outer
    one is longer), odd ids in the first of two divs of equal length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nested = F.concat(F.lit('<div class="x"><div>'), _escaped(text), F.lit("</div><p>tail</p></div><div>small</div>"))
    equal = F.concat(F.lit("<div>"), _escaped(text), F.lit("</div><div>"), _escaped(F.reverse(text)), F.lit("</div>"))
    html = F.concat(F.lit("<html><body>"), F.when(F.col("doc_id") % 2 == 0, nested).otherwise(equal), F.lit("</body></html>"))
    d = B.table(spark, sf, "documents")
    return X.tier_text(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), "heavy_div")


@register("paragraphs", f"""
WITH {_PARAGRAPHS}
SELECT page_id, para_text AS tier_text, CAST(length(para_text) AS BIGINT) AS tier_length,
       length(para_text) >= {_LEAST} AS tier_ok FROM paras""")
def q_paragraphs(spark, sf):
    """X8 for every page, nested paragraphs counted as the ranges have them."""
    return X.tier_text(B.table(spark, sf, "pages"), "paragraphs")


_INTERNAL_TEXT = Q.clean(Q.decode_entities(Q.tags_to_space(_ARTICLE)))


@register("extract_internal", f"""
SELECT page_id, page_id % 2 = 0 AND strpos(html, '<article') > 0 AS success,
       CASE WHEN page_id % 2 = 0 AND strpos(html, '<article') > 0 THEN {_INTERNAL_TEXT} END AS text,
       CASE WHEN page_id % 2 = 0 AND strpos(html, '<article') > 0 THEN NULL ELSE 'NO_CONTENT' END AS warning
FROM pages""")
def q_extract_internal(spark, sf):
    """X10 with the default content element: every other page has its article under that name,
    the rest have no such element; no length threshold."""
    own = S.INTERNAL_CONTENT_SELECTOR
    renamed = F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit(f"<{own}>")),
                        F.lit("</article>"), F.lit(f"</{own}>"))
    pages = B.table(spark, sf, "pages").withColumn(
        "html", F.when(F.col("page_id") % 2 == 0, renamed).otherwise(F.col("html"))).withColumn(
        "route", F.lit(S.SOURCE_INTERNAL))
    return X.extract_corpus(pages).select("page_id", "details.success", "details.text", "details.warning")


@register("load_html_corpus", f"""
WITH {_DETAILS}
SELECT page_id, CAST(CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS INTEGER) AS http_status,
       page_id % 10 <> 3 AND success AS success,
       CASE WHEN page_id % 10 = 3 THEN 'HTTP 404' ELSE error END AS error,
       CASE WHEN page_id % 10 <> 3 THEN warning END AS warning FROM page_details""")
def q_load_html_corpus(spark, sf):
    """A5: the corpus landed with a fetch status (every tenth fetch failed), read and extracted."""
    path = scratch_path(spark, "landed-pages")
    failed = F.col("page_id") % 10 == 3
    B.table(spark, sf, "pages").withColumn("html", F.when(~failed, F.col("html"))).withColumn(
        "http_status", F.when(failed, 404).otherwise(200)).write.parquet(path)
    pages = load_html_corpus(spark, path)
    out = X.extract_corpus(pages).join(pages.select("page_id", "http_status"), "page_id")
    return out.select("page_id", "http_status", "details.success", "details.error", "details.warning")
