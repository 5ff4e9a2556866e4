"""Text extraction over an HTML corpus as Spark jobs.

Routing, de-duplicating fetch URLs, the order of the tiers, their thresholds, texts,
warnings and domains are DataFrame code.  Only the parse runs in Python, on Arrow batches:
a task turns each page once into its strings and the ranges of the elements that matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from listforge import schemas as S
from listforge.functions import columns as C
from listforge.functions import page_text as P
from listforge.functions.memory import give_back
from listforge.session import ship_package

_SPAN = T.StructType().add("first", "integer").add("n", "integer")
_PARTS = (T.StructType().add("ld", "string").add("ld_error", "string").add("strings", T.ArrayType(T.StringType()))
          .add("main", _SPAN).add("heavy", _SPAN).add("paragraphs", T.ArrayType(_SPAN)).add("body", _SPAN)
          .add("error", "string"))
NO_ELEMENT = "Content selector not found"
SLICE_CHARS = 1_000_000   # pages whose parts a task holds as Python objects; a longer page is alone


def _slices(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about ``SLICE_CHARS`` bytes in a string column."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(col)).to_pylist()):
        size += n or 0
        if size >= SLICE_CHARS:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def parse_pages(pages: DataFrame, options: P.ExtractOptions = P.DEFAULT_OPTIONS) -> DataFrame:
    """(k, html, internal) -> (k, parts): strings and ranges of every page, parsed once."""
    ship_package(pages.sparkSession)
    parts_type = to_arrow_type(_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                found = pa.array((P.page_parts(h.as_py(), i.as_py(), options)
                                  for h, i in zip(part.column(1), part.column(2), strict=True)), type=parts_type)
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["k", "parts"])
                del found
                give_back()

    schema = T.StructType([pages.schema["k"], T.StructField("parts", _PARTS)])
    return pages.select("k", "html", "internal").mapInArrow(run, schema)


def _joined(span: Column, separator: str) -> Column:
    return F.array_join(F.slice(F.col("parts.strings"), span["first"] + 1, span["n"]), separator)


def _span_text(name: str) -> Column:
    """Cleaned text of an element; null without it."""
    span = F.col(f"parts.{name}")
    return F.when(span.isNotNull(), C.clean_text(_joined(span, "\n")))


def _heavy_text(least: int) -> Column:
    """Cleaned text of the longest div if its raw text is long enough."""
    raw = _joined(F.col("parts.heavy"), "\n")
    return F.when(F.length(raw) >= max(1, least), C.clean_text(raw))


def _paragraph_text() -> Column:
    return C.clean_text(F.array_join(F.transform("parts.paragraphs", lambda p: _joined(p, " ")), " "))


def _short_error(text: Column) -> Column:
    return F.concat(F.lit("Insufficient content ("), F.length(text).cast("string"), F.lit(" chars)"))


def extract_corpus(pages: DataFrame, options: P.ExtractOptions = P.DEFAULT_OPTIONS,
                   key_cols: tuple = ("page_id",)) -> DataFrame:
    """(key..., url, html[, route][, http_status]) -> (key..., url, details).

    ``route`` picks the cascade per row ('external' default, 'internal' for the
    custom-element pages, 'none' for rows without any address).  A non-200
    ``http_status`` gives a failure row without a warning (statistics count it as
    UNKNOWN).  ``html`` is dropped.
    """
    cols, least = set(pages.columns), options.min_valid_length
    route = F.col("route") if "route" in cols else F.lit(S.SOURCE_EXTERNAL)
    status = F.col("http_status").cast("int") if "http_status" in cols else F.lit(200)
    fetched = ~F.coalesce(route == S.SOURCE_NONE, F.lit(False)) & F.coalesce(status == 200, F.lit(True))
    parsed = parse_pages(pages.select(
        F.struct(*key_cols, "url", route.alias("route"), status.alias("http_status")).alias("k"),
        F.when(fetched, F.col("html")).alias("html"),
        F.coalesce(route == S.SOURCE_INTERNAL, F.lit(False)).alias("internal")), options)
    kind, url = F.col("k.route"), F.col("k.url")
    internal = F.coalesce(kind == S.SOURCE_INTERNAL, F.lit(False))
    broken = F.coalesce(F.col("parts.error"), F.col("parts.ld_error"))

    # each text is made only where no earlier tier has decided the page
    t = parsed.withColumns({"ld": C.clean_text("parts.ld"), "main": _span_text("main")})
    t = t.withColumn("tier", F.when(kind == S.SOURCE_NONE, "none").when(F.col("k.http_status") != 200, "http")
                     .when(broken.isNotNull(), "broken")
                     .when(internal, F.when(F.col("main").isNotNull(), "internal").otherwise("no element"))
                     .when(F.col("ld") != "", "ld").when(F.length("main") >= least, "main")
                     .when(C.needs_javascript("main"), "script"))
    for name, text in (("heavy", _heavy_text(least)), ("paragraphs", _paragraph_text()),
                       ("body", F.coalesce(_span_text("body"), F.lit("")))):
        t = t.withColumn(name, F.when(F.col("tier").isNull(), text))
        good = (F.col(name).isNotNull() if name == "heavy"
                else (F.col(name) != "") & (F.length(name) >= least) if name == "paragraphs" else F.lit(True))
        t = t.withColumn("tier", F.coalesce("tier", F.when(good, name)))
    tier = F.col("tier")

    def by_tier(**values) -> Column:
        """A value by tier, null for the tiers not named."""
        return F.coalesce(*[F.when(tier == name.replace("_", " "), value) for name, value in values.items()])

    text = by_tier(ld=F.col("ld"), main=F.col("main"), internal=F.col("main"), script=F.col("main"),
                   heavy=F.col("heavy"), paragraphs=F.col("paragraphs"), body=F.col("body"),
                   broken=F.when(F.col("parts.error") == P.NO_INTERNAL_PAGE, F.lit("")))
    t = t.withColumn("text", text)
    body = F.col("text")
    details = {
        "success": tier.isin("ld", "main", "heavy", "paragraphs", "internal"),
        "text": body,
        "url": F.when(tier != "none", url),
        "source": F.when(tier == "none", S.SOURCE_NONE).when(tier == "http", kind)
        .when(internal, S.SOURCE_INTERNAL).otherwise(S.SOURCE_EXTERNAL),
        "method": by_tier(ld=S.METHOD_JSON_LD, main=S.METHOD_CSS, internal=S.METHOD_CSS, script=S.METHOD_CSS,
                          heavy=S.METHOD_HEAVY_DIV, paragraphs=S.METHOD_PARAGRAPHS, body=S.METHOD_FALLBACK),
        "text_length": F.when(tier != "none", F.coalesce(F.length("text"), F.lit(0))),
        "domain": F.when(tier == "none", F.lit(None)).when(internal, F.lit(options.internal_domain)).otherwise(
            C.url_domain(url)),
        "warning": by_tier(broken=S.WARN_EXCEPTION, no_element=S.WARN_NO_CONTENT, script=S.WARN_JS_REQUIRED,
                           body=C.fallback_warning(body, least)),
        "error": by_tier(none=F.lit("No refnr or external URL available"),
                         http=F.concat(F.lit("HTTP "), F.col("k.http_status").cast("string")), broken=broken,
                         no_element=F.lit(NO_ELEMENT), script=F.lit("JavaScript required"), body=_short_error(body)),
    }
    row = F.struct(*[details[f.name].cast(f.dataType).alias(f.name) for f in S.DETAILS.fields])
    return t.select(*[F.col("k")[c].alias(c) for c in key_cols], url.alias("url"), row.alias("details"))


def _parts_by_id(pages: DataFrame, options: P.ExtractOptions) -> DataFrame:
    return parse_pages(pages.select(F.struct("page_id", "url").alias("k"), "html", F.lit(False).alias("internal")), options)


def tier_text(pages: DataFrame, tier: str,
              options: P.ExtractOptions = P.DEFAULT_OPTIONS) -> DataFrame:
    """One tier on its own for every page: 'json_ld' (X4), 'heavy_div' (X7), 'paragraphs' (X8).

    X4 and X7 are null where the tier finds nothing, X8 is empty.
    """
    text = {"json_ld": F.when(F.col("parts.ld").isNotNull(), C.clean_text("parts.ld")),
            "heavy_div": _heavy_text(options.min_valid_length), "paragraphs": _paragraph_text()}[tier]
    t = _parts_by_id(pages, options).select(F.col("k.page_id").alias("page_id"), text.alias("tier_text"))
    return t.select("page_id", "tier_text",
                    F.length("tier_text").cast("long").alias("tier_length"),
                    (F.coalesce(F.length("tier_text"), F.lit(0)) >= options.min_valid_length)
                    .alias("tier_ok"))


def main_content(pages: DataFrame, options: P.ExtractOptions = P.DEFAULT_OPTIONS) -> DataFrame:
    """X5+X6 for every page: text of the main-content element after boilerplate removal."""
    t = _parts_by_id(pages, options).select("k.page_id", "k.url", F.coalesce(_span_text("main"), F.lit("")).alias("main_text"))
    return t.select(
        "page_id",
        C.url_domain("url").alias("domain"),
        "main_text",
        F.length("main_text").cast("long").alias("main_length"),
        (F.length("main_text") >= options.min_valid_length).alias("main_ok"),
        C.needs_javascript("main_text").alias("main_js"),
    )


def fallback_outcome(pages: DataFrame, options: P.ExtractOptions = P.DEFAULT_OPTIONS) -> DataFrame:
    """X5+X9 for every page: body text after boilerplate removal and the warning rule."""
    t = _parts_by_id(pages, options).select("k.page_id", F.coalesce(_span_text("body"), F.lit("")).alias("body_text"))
    return t.select(
        "page_id",
        "body_text",
        F.length("body_text").cast("long").alias("body_length"),
        C.fallback_warning("body_text", options.min_valid_length).alias("warning"),
        _short_error(F.col("body_text")).alias("error"),
    )


def extract_listings(listings: DataFrame, pages: DataFrame, internal_base_url: str,
                     options: P.ExtractOptions = P.DEFAULT_OPTIONS) -> DataFrame:
    """Route each listing, extract each distinct landed page once, attach DETAILS.

    ``pages`` holds landed fetches (url, html[, http_status]); of several for one URL the
    newest counts, by ``landed_at`` or else ``page_id`` (ties, and tables with neither: the
    largest row hash).  A listing whose page has not landed gets an EXCEPTION failure.
    Listings keep every column and gain ``details``.
    """
    routed = listings.withColumn("_route", C.route_source("external_url", "ref_id")).withColumn(
        "_fetch_url",
        F.when(F.col("_route") == S.SOURCE_EXTERNAL, F.col("external_url"))
        .when(F.col("_route") == S.SOURCE_INTERNAL, C.detail_url(internal_base_url, F.col("ref_id"))),
    )
    wanted = routed.select(F.col("_fetch_url").alias("url"), F.col("_route").alias("route")).where(
        F.col("route") != S.SOURCE_NONE).distinct()
    page_cols = ["url", "html"] + (["http_status"] if "http_status" in pages.columns else [])
    # narrow semi join first (AQE broadcasts the wanted URLs when they are few), so only
    # the pages that are needed reach the de-duplicating shuffle
    order = next((c for c in ("landed_at", "page_id") if c in pages.columns), None)
    age = F.struct(F.col(order) if order else F.lit(0), F.xxhash64(*page_cols))
    fetched = pages.select(*page_cols, age.alias("_age")).join(wanted.select("url").distinct(), "url", "left_semi")
    newest = fetched.groupBy("url").agg(F.max("_age").alias("_age"))  # narrow
    landed = fetched.join(newest, ["url", "_age"]).drop("_age").dropDuplicates(["url"])  # equal rows only
    todo = wanted.join(landed, "url", "left")
    details = extract_corpus(todo.select("url", "html", "route",
                                         *(["http_status"] if "http_status" in page_cols else [])),
                             options, key_cols=())
    # (url, route) is the exact key: the route comes back as details.source
    details = details.select(F.col("url").alias("_fetch_url"),
                             F.col("details.source").alias("_route"), "details")
    none_details = F.struct(
        F.lit(False).alias("success"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("url"), F.lit(S.SOURCE_NONE).alias("source"),
        F.lit(None).cast("string").alias("method"), F.lit(None).cast("long").alias("text_length"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("warning"),
        F.lit("No refnr or external URL available").alias("error"),
    )
    # rows without any address have no key to join on: they don't meet in one task
    addressed = routed.where(F.col("_route") != S.SOURCE_NONE).join(details, ["_fetch_url", "_route"], "left")
    nowhere = routed.where(F.col("_route") == S.SOURCE_NONE).withColumn("details", none_details)
    return addressed.unionByName(nowhere).drop("_route", "_fetch_url")


def split_outcomes(listings: DataFrame, internal_base_url: str) -> tuple[DataFrame, DataFrame]:
    """(OK, FAILED) projections of listings with DETAILS."""
    ok_flag = F.coalesce(F.col("details.success"), F.lit(False))
    title = F.coalesce(F.col("title"), F.lit(""))
    city = F.coalesce(F.col("location.city"), F.lit(""))
    employer = F.coalesce(F.col("employer"), F.lit(""))
    ok = listings.where(ok_flag).select(
        "ref_id" if "ref_id" in listings.columns else F.lit(None).alias("ref_id"),
        title.alias("title"), city.alias("city"), employer.alias("employer"),
        F.col("details.text").alias("text"),
        F.coalesce(F.col("details.url"), F.lit("")).alias("url"),
        *([c for c in ("process_ord", "batch_ord") if c in listings.columns]),
    )
    failed = listings.where(~ok_flag).select(
        title.alias("title"), city.alias("city"), employer.alias("employer"),
        resolve_failed_url(internal_base_url).alias("url"),
        C.error_type(F.col("details.warning")).alias("error_type"),
        F.coalesce(F.col("details.error"), F.lit("Unknown error")).alias("error_details"),
        *([c for c in ("ref_id", "batch_ord") if c in listings.columns]),
    )
    return ok, failed


def resolve_failed_url(internal_base_url: str):
    """Details url, else external url; if still empty and a ref exists, the detail page."""
    first = F.coalesce(F.nullif(F.col("details.url"), F.lit("")),
                       F.nullif(F.col("external_url"), F.lit("")))
    ref = F.coalesce(F.col("ref_id"), F.lit(""))
    return (F.when(first.isNotNull(), first)
            .when(ref != "", C.detail_url(internal_base_url, F.col("ref_id")))
            .otherwise(F.lit("")))
