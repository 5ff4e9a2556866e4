"""Explicit schemas (never inferred) and the fixed values the pipeline relies on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the studied pipeline's values for results to
# agree; they are stated here plainly and together.
# ---------------------------------------------------------------------------
# label set, best first
CATEGORY_EXCELLENT = "Excellent Match"
CATEGORY_GOOD = "Good Match"
CATEGORY_POOR = "Poor Match"
CATEGORIES = [CATEGORY_EXCELLENT, CATEGORY_GOOD, CATEGORY_POOR]
MATCH_CATEGORIES = [CATEGORY_EXCELLENT, CATEGORY_GOOD]
# sort priority of a category in the ranked export; anything else ranks 999
CATEGORY_PRIORITY = {CATEGORY_EXCELLENT: 0, CATEGORY_GOOD: 1, CATEGORY_POOR: 2}
UNRANKED_PRIORITY = 999

# extraction warnings
WARN_JS_REQUIRED = "JS_REQUIRED"
WARN_SHORT_CONTENT = "SHORT_CONTENT"
WARN_LOW_QUALITY = "LOW_QUALITY"
WARN_NO_CONTENT = "NO_CONTENT"
WARN_EXCEPTION = "EXCEPTION"
WARN_EXCESSIVE_CONTENT = "EXCESSIVE_CONTENT"
# warning -> short error type of a failed row; anything else -> "ERROR"
ERROR_TYPE_BY_WARNING = {
    "JS_REQUIRED": "JS_REQUIRED",
    "SHORT_CONTENT": "SHORT_CONTENT",
    "NO_CONTENT": "NO_CONTENT",
    "TIMEOUT": "TIMEOUT",
    "EXCEPTION": "EXCEPTION",
    "UNKNOWN": "ERROR",
}

# extraction methods
METHOD_CSS = "css_selector"
METHOD_JSON_LD = "json_ld"
METHOD_HEAVY_DIV = "content_heavy_div"
METHOD_PARAGRAPHS = "paragraph_aggregation"
METHOD_FALLBACK = "fallback"

# page sources
SOURCE_EXTERNAL = "external"
SOURCE_INTERNAL = "internal"
SOURCE_NONE = "none"

# length thresholds of the extraction cascade
MIN_VALID_TEXT_LENGTH = 1000
JS_PLACEHOLDER_MAX_LENGTH = 500
MIN_PARAGRAPH_LENGTH = 20

# extraction defaults
REMOVE_TAGS = ["script", "style", "nav", "header", "footer", "aside", "iframe"]
INTERNAL_REMOVE_TAGS = ["script", "style", "nav", "header", "footer"]
REMOVE_CLASS_PATTERN = "(nav|menu|sidebar|breadcrumb|cookie|popup)"
PRIMARY_SELECTOR = "main"
SECONDARY_SELECTOR = "article"
CONTENT_CLASS_PATTERN = "(content|job|detail|description)"
CONTENT_ID_PATTERN = "(content|job|detail|main)"
INTERNAL_CONTENT_SELECTOR = "jb-steadetail-beschreibung"

# search / labelling defaults
DEFAULT_EXCLUDE_KEYWORDS = ["weiterbildung", "ausbildung"]
DEFAULT_INCREMENTAL_DAYS = 7
DEFAULT_BATCH_SIZE = 70
MAX_TEXT_CHARS = 25000
MAX_SHORT_ID_BATCH = 999
DEFAULT_DISABLE_REASON = "Job description too large (likely scraped entire webpage)"

# Python's str.isspace() set, so whitespace collapsing agrees with the studied code
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{000B}\x{000C}\r\x{001C}-\x{001F} \x{0085}\x{00A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
LOCATION = T.StructType([T.StructField("city", T.StringType())])

LISTING = T.StructType([
    T.StructField("ref_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("employer", T.StringType()),
    T.StructField("location", LOCATION),
    T.StructField("external_url", T.StringType()),
    T.StructField("modified_at", T.StringType()),
    T.StructField("published_on", T.DateType()),
    T.StructField("batch_ord", T.LongType()),
])

DETAILS = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("text_length", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("warning", T.StringType()),
    T.StructField("error", T.StringType()),
])

FOUND_IN = T.ArrayType(T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("place", T.StringType()),
    T.StructField("first_match", T.TimestampType()),
]))

PAYLOAD_FIELDS = ["title", "employer", "location", "external_url", "modified_at", "published_on"]

STORE = T.StructType(
    [f for f in LISTING.fields if f.name != "batch_ord"]
    + [
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("found_in", FOUND_IN),
        T.StructField("details", DETAILS),
    ]
)

STORE_META = T.StructType([
    T.StructField("created", T.TimestampType()),
    T.StructField("last_updated", T.TimestampType()),
    T.StructField("total", T.LongType()),
    T.StructField("active", T.LongType()),
    T.StructField("place", T.StringType()),
    T.StructField("radius_km", T.IntegerType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# one landed search response page
SEARCH_PAGE = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("total", T.StringType()),
    T.StructField("listings", T.ArrayType(T.StructType([
        T.StructField("ref_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("employer", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("external_url", T.StringType()),
        T.StructField("modified_at", T.StringType()),
        T.StructField("published_on", T.DateType()),
    ]))),
])

RESPONSE = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("batch_no", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("raw_json", T.StringType()),
])

# provider response JSON (only the fields that are read)
RESPONSE_JSON = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([
            T.StructField("content", T.StringType()),
            T.StructField("reasoning", T.StringType()),
            T.StructField("reasoning_details", T.ArrayType(T.StructType([
                T.StructField("type", T.StringType()),
                T.StructField("text", T.StringType()),
            ]))),
        ])),
    ]))),
    T.StructField("usage", T.StructType([
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("completion_tokens_details", T.StructType([
            T.StructField("reasoning_tokens", T.LongType()),
        ])),
    ])),
])
