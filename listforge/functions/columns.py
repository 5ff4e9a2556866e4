"""Column expressions: built-in Spark functions only, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listforge import schemas as S

# scheme is optional: '//host/x' has a network location too
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Null -> ''; whitespace runs (Python's set, incl. NBSP) -> one space; trimmed."""
    collapsed = F.regexp_replace(F.coalesce(_c(col), F.lit("")), S.PY_WHITESPACE_CLASS + "+", " ")
    return F.trim(collapsed)


def url_domain(col) -> Column:
    """Network location incl. user and port; '' when there is none."""
    return F.regexp_extract(_c(col), _NETLOC, 1)


def needs_javascript(col) -> Column:
    """Non-empty, shorter than 500 characters, mentions javascript in any case."""
    t = _c(col)
    return (
        t.isNotNull()
        & (F.length(t) > 0)
        & (F.length(t) < S.JS_PLACEHOLDER_MAX_LENGTH)
        & F.lower(t).contains("javascript")
    )


def fallback_warning(text, min_len: int = S.MIN_VALID_TEXT_LENGTH) -> Column:
    """X9 warning rule on an already cleaned text."""
    t = _c(text)
    return (
        F.when(needs_javascript(t), F.lit(S.WARN_JS_REQUIRED))
        .when(F.length(t) < min_len, F.lit(S.WARN_SHORT_CONTENT))
        .otherwise(F.lit(S.WARN_LOW_QUALITY))
    )


def route_source(external_url, ref_id) -> Column:
    """External when the external URL is non-blank, internal when a ref exists, else none."""
    ext = F.trim(F.coalesce(_c(external_url), F.lit("")))
    ref = F.coalesce(_c(ref_id), F.lit(""))
    return (
        F.when(ext != "", F.lit(S.SOURCE_EXTERNAL))
        .when(ref != "", F.lit(S.SOURCE_INTERNAL))
        .otherwise(F.lit(S.SOURCE_NONE))
    )


def error_type(warning) -> Column:
    """Warning -> short error type; missing -> ERROR; unlisted -> ERROR."""
    mapping = F.create_map(*[F.lit(x) for kv in S.ERROR_TYPE_BY_WARNING.items() for x in kv])
    w = F.coalesce(_c(warning), F.lit("UNKNOWN"))
    return F.coalesce(F.try_element_at(mapping, w), F.lit("ERROR"))


def slug(col) -> Column:
    """Lower-case without spaces, underscores and hyphens."""
    return F.translate(F.lower(_c(col)), " _-", "")


def detail_url(base: str, ref_id) -> Column:
    """Base + '/' + ref."""
    return F.concat(F.lit(base), F.lit("/"), _c(ref_id))


RUN_ID_PATTERN = r"^[0-9]{8}_[0-9]{6}$"


def run_id_of(ts) -> Column:
    """Timestamp -> run id."""
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")


def run_id_valid(run_id) -> Column:
    return F.coalesce(_c(run_id).rlike(RUN_ID_PATTERN), F.lit(False))


def run_id_timestamp(run_id) -> Column:
    """Run id -> timestamp, null when the id is malformed."""
    return F.when(run_id_valid(run_id), F.try_to_timestamp(_c(run_id), F.lit("yyyyMMdd_HHmmss")))


def category_priority(categories) -> Column:
    """Best (lowest) priority of a category list; unknown or none -> 999."""
    prio = F.create_map(*[F.lit(x) for kv in S.CATEGORY_PRIORITY.items() for x in kv])
    per_cat = F.transform(
        F.coalesce(_c(categories), F.array().cast("array<string>")),
        lambda c: F.coalesce(F.try_element_at(prio, c), F.lit(S.UNRANKED_PRIORITY)),
    )
    return F.coalesce(F.array_min(per_cat), F.lit(S.UNRANKED_PRIORITY))


def is_match(categories) -> Column:
    """Carries Excellent or Good."""
    return F.coalesce(
        F.arrays_overlap(_c(categories), F.array(*[F.lit(c) for c in S.MATCH_CATEGORIES])),
        F.lit(False),
    )
