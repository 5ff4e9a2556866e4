"""Extraction-quality and category statistics.

Inputs:
- extraction statistics take rows with ``ord`` (arrival order, LONG) and a
  ``details`` struct (DETAILS; a null struct counts as an unknown failure), or, but for E11,
  ``stat_partials`` of such rows;
- category statistics take rows with ``ord`` and ``categories`` ARRAY<STRING>.

Every aggregation is a plain ``groupBy`` (partial aggregation before the
shuffle, so a hot domain or source is pre-aggregated map-side).  Wide columns
never reach a shuffle: text enters only as its length.  Ties are broken by
first appearance (``min(ord)``) wherever the studied pipeline relied on dict
insertion order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.functions import columns as C


# ---------------------------------------------------------------------------
# extraction statistics
# ---------------------------------------------------------------------------
def details_view(df: DataFrame, *keep: str) -> DataFrame:
    """Narrow rows used by all extraction statistics (no text, no html), with their weight ``n``.

    Listings weigh 1 each; ``stat_partials`` rows pass as they are, so every statistic below
    can be taken from either.  Columns named in ``keep`` go along.
    """
    if "stat_n" in df.columns:
        return df.withColumnRenamed("stat_n", "n")
    d = F.col("details")
    length_or_text = F.coalesce(d["text_length"], F.length(F.coalesce(d["text"], F.lit("")))).cast("long")
    length_or_zero = F.coalesce(d["text_length"], F.lit(0)).cast("long")
    return df.select(
        *keep, F.coalesce(d["source"], F.lit("unknown")).alias("source"),
        F.coalesce(d["success"], F.lit(False)).alias("success"),
        F.coalesce(d["domain"], F.lit("unknown")).alias("domain"),
        d["method"].alias("method"), d["warning"].alias("warning"),
        F.lit(1).cast("long").alias("n"), F.col("ord").cast("long").alias("first_ord"),
        length_or_text.alias("chars"), length_or_zero.alias("chars_zero"),
        length_or_zero.alias("chars_min"), length_or_zero.alias("chars_max"))


FACETS = ["source", "success", "domain", "method", "warning"]


def stat_partials(df: DataFrame, *by: str) -> DataFrame:
    """Mergeable partial statistics: one row per combination of the facets that E5-E12 and E22 use.

    Partials of disjoint sets of listings, stacked and put through this again, are those of all.
    ``by`` names further columns of partials to keep apart.
    """
    return details_view(df).groupBy(*by, *FACETS).agg(
        F.sum("n").alias("stat_n"), F.min("first_ord").alias("first_ord"), F.sum("chars").alias("chars"),
        F.sum("chars_zero").alias("chars_zero"), F.min("chars_min").alias("chars_min"),
        F.max("chars_max").alias("chars_max"))


def _successful():
    return F.sum(F.when(F.col("success"), F.col("n")).otherwise(F.lit(0))).cast("long")


def stats_by_source(df: DataFrame) -> DataFrame:
    """E5: per source total, successful, failed, floor-average text length."""
    v = details_view(df)
    return v.groupBy("source").agg(
        F.sum("n").alias("total"), _successful().alias("successful"),
        (F.sum("n") - _successful()).alias("failed"),
        F.floor(F.sum("chars") / F.sum("n")).cast("long").alias("avg_text_length"),
    )


def _domain_core(df: DataFrame) -> DataFrame:
    """Per external domain: counts, length range, first appearance and F5 primaries.

    One scan: GROUPING SETS ((domain, warning), (domain, method)) aggregates the
    narrow rows once (partial aggregation before the shuffle), and a second,
    small aggregation per domain folds the two sets together.  Every row is in
    exactly one (domain, method) group, so domain totals come from that set.
    """
    v = details_view(df).where(F.col("source") == S.SOURCE_EXTERNAL).select(
        "domain", "first_ord", "success", "n", "chars_zero", "chars_min", "chars_max",
        F.when(F.coalesce(F.col("warning"), F.lit("")) != "", F.col("warning")).alias("w_key"),
        F.coalesce(F.col("method"), F.lit("unknown")).alias("m_key"))
    sets = v.groupingSets([["domain", "w_key"], ["domain", "m_key"]], "domain", "w_key", "m_key") \
        .agg(F.grouping_id().alias("_gid"), F.sum("n").alias("_n"),
             F.min("first_ord").alias("_first"), _successful().alias("_ok"),
             F.sum("chars_zero").alias("_len"), F.min("chars_min").alias("_min"),
             F.max("chars_max").alias("_max"))
    by_method = F.col("m_key").isNotNull() & F.col("w_key").isNull() & (F.col("_gid") == 2)
    by_warning = (F.col("_gid") == 1) & F.col("w_key").isNotNull()
    rank = F.struct(F.col("_n"), -F.col("_first"))
    agg = sets.groupBy("domain").agg(
        F.sum(F.when(by_method, F.col("_n"))).alias("total"),
        F.sum(F.when(by_method, F.col("_ok"))).alias("successful"),
        F.sum(F.when(by_method, F.col("_len"))).alias("_len_sum"),
        F.min(F.when(by_method, F.col("_min"))).alias("min_text_length"),
        F.max(F.when(by_method, F.col("_max"))).alias("max_text_length"),
        F.min(F.when(by_method, F.col("_first"))).alias("first_ord"),
        F.max_by(F.when(by_warning, F.col("w_key")), F.when(by_warning, rank)).alias("primary_warning"),
        F.max_by(F.when(by_method, F.col("m_key")), F.when(by_method, rank)).alias("primary_method"),
    )
    return agg.select(
        "domain", F.col("total").cast("long").alias("total"),
        F.col("successful").cast("long").alias("successful"),
        (F.col("total") - F.col("successful")).cast("long").alias("failed"),
        F.floor(F.col("_len_sum") / F.col("total")).cast("long").alias("avg_text_length"),
        "min_text_length", "max_text_length", "first_ord",
        (F.col("successful").cast("double") / F.col("total") * 100.0).alias("rate_raw"),
        "primary_warning", "primary_method")


def stats_by_domain(df: DataFrame) -> DataFrame:
    """External rows per domain with rate, length range and primary warning/method."""
    return _domain_core(df).select(
        "domain", "total", "successful", "failed",
        F.round("rate_raw", 1).alias("success_rate"),
        "avg_text_length", "min_text_length", "max_text_length",
        "primary_warning", "primary_method",
    )


def stats_by_method(df: DataFrame) -> DataFrame:
    """Count per extraction method; unknown/missing excluded, failures included."""
    v = details_view(df)
    return (v.where(F.col("method").isNotNull() & (F.col("method") != "")
                    & (F.col("method") != "unknown"))
            .groupBy("method").agg(F.sum("n").alias("n")))


def stats_by_warning(df: DataFrame) -> DataFrame:
    """Count per non-empty warning."""
    v = details_view(df)
    return (v.where(F.coalesce(F.col("warning"), F.lit("")) != "")
            .groupBy("warning").agg(F.sum("n").alias("n")))


def failures_by_warning(df: DataFrame) -> DataFrame:
    """Failed rows per warning; missing -> UNKNOWN."""
    v = details_view(df).where(~F.col("success"))
    return v.groupBy(F.coalesce(F.col("warning"), F.lit("UNKNOWN")).alias("warning")).agg(
        F.sum("n").alias("failures"))


def failures_by_domain_top(df: DataFrame, k: int = 10) -> DataFrame:
    """The k domains with most failures (first failing first on ties)."""
    v = details_view(df).where(~F.col("success"))
    agg = v.groupBy("domain").agg(F.sum("n").alias("failures"), F.min("first_ord").alias("first_ord"))
    return agg.orderBy(F.desc("failures"), F.asc("first_ord")).limit(k).select("domain", "failures")


def failure_details(df: DataFrame) -> DataFrame:
    """One row per failed listing with its 1-based position among all rows.

    ``df`` needs ``ord``, ``details`` and may carry ``title``, ``external_url``,
    ``ref_id``.  The position is the rank of ``ord`` among all rows.
    """
    from listforge.operators.indexing import global_index

    cols = set(df.columns)
    title = F.col("title") if "title" in cols else F.lit(None).cast("string")
    ext = F.col("external_url") if "external_url" in cols else F.lit(None).cast("string")
    ref = F.col("ref_id") if "ref_id" in cols else F.lit(None).cast("string")
    narrow = df.select(
        F.col("ord").cast("long").alias("ord"),
        F.coalesce(F.col("details.success"), F.lit(False)).alias("_ok"),
        F.coalesce(title, F.lit("N/A")).alias("title"),
        F.coalesce(F.col("details.url"), ext,
                   F.concat(F.lit("refnr:"), F.coalesce(ref, F.lit("None")))).alias("url"),
        F.coalesce(F.col("details.domain"), F.lit("unknown")).alias("domain"),
        F.coalesce(F.col("details.error"), F.lit("Unknown")).alias("error"),
        F.coalesce(F.col("details.warning"), F.lit("UNKNOWN")).alias("warning"),
    )
    indexed = global_index(narrow, ["ord"], name="_pos")
    return indexed.where(~F.col("_ok")).select(
        (F.col("_pos") + 1).alias("ordinal"), "title", "url", "domain", "error", "warning")


def problem_domains(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Domains with rate < 50 on >= 3 rows, by total desc then first seen."""
    core = _domain_core(df).where((F.col("rate_raw") < 50) & (F.col("total") >= 3))
    out = core.select("domain", "total", F.round("rate_raw", 1).alias("success_rate"),
                      "primary_warning", "first_ord")
    if limit is not None:
        out = out.orderBy(F.desc("total"), F.asc("first_ord")).limit(limit)
    return out


def good_domains(df: DataFrame) -> DataFrame:
    """Domains with rate >= 80 on >= 3 rows (sort keys: total desc, first_ord)."""
    core = _domain_core(df).where((F.col("rate_raw") >= 80) & (F.col("total") >= 3))
    return core.select("domain", "total", F.round("rate_raw", 1).alias("success_rate"),
                       "primary_method", "first_ord")


def extraction_report(df: DataFrame, top_problems: int = 5) -> DataFrame:
    """Report rows (section, item, n, total, pct, avg_text_length, primary_warning).

    A source has its successes, its total, the rate and the floor-average text length; a
    method its count, that of all methods and the share; a warning its count; a problem
    domain its total, rate and primary warning.  Sources, methods and warnings come from one GROUPING SETS pass that is read by
    a single projection; problem domains come from the domain pass.
    """
    v = details_view(df).select(
        "source", "success", "n", "chars",
        F.when(F.col("method").isNotNull() & (F.col("method") != "")
               & (F.col("method") != "unknown"), F.col("method")).alias("m_key"),
        F.when(F.coalesce(F.col("warning"), F.lit("")) != "", F.col("warning")).alias("w_key"))
    facets = v.groupingSets([["source"], ["m_key"], ["w_key"]], "source", "m_key", "w_key").agg(
        F.grouping_id().alias("_gid"), F.sum("n").alias("_n"),
        _successful().alias("_ok"), F.sum("chars").alias("_chars"))
    # grouping ids: (source) -> 3, (m_key) -> 5, (w_key) -> 6
    section = (F.when(F.col("_gid") == 3, F.lit("source"))
               .when((F.col("_gid") == 5) & F.col("m_key").isNotNull(), F.lit("method"))
               .when((F.col("_gid") == 6) & F.col("w_key").isNotNull(), F.lit("warning")))
    rows = facets.select(section.alias("section"),
                         F.coalesce("source", "m_key", "w_key").alias("item"), "_n", "_ok", "_chars") \
        .where(F.col("section").isNotNull())
    # the facet table has one row per source, method and warning value: windows on it are tiny
    method_total = F.sum(F.when(F.col("section") == "method", F.col("_n"))).over(
        Window.partitionBy(F.lit(1)))
    facet_rows = rows.select(
        "section", "item",
        F.when(F.col("section") == "source", F.col("_ok")).otherwise(F.col("_n")).alias("n"),
        F.when(F.col("section") == "source", F.col("_n")).when(F.col("section") == "method", method_total)
        .alias("total"),
        F.when(F.col("section") == "source",
               F.when(F.col("_n") > 0, F.col("_ok").cast("double") / F.col("_n") * 100.0)
               .otherwise(F.lit(0.0)))
        .when(F.col("section") == "method", F.col("_n").cast("double") / method_total * 100.0)
        .alias("pct"),
        F.when(F.col("section") == "source", F.floor(F.col("_chars") / F.col("_n")).cast("long"))
        .alias("avg_text_length"), F.lit(None).cast("string").alias("primary_warning"))
    prob = problem_domains(df, limit=top_problems).select(
        F.lit("problem_domain").alias("section"), F.col("domain").alias("item"),
        F.col("total").alias("n"), "total", F.col("success_rate").alias("pct"),
        F.lit(None).cast("long").alias("avg_text_length"), "primary_warning")
    return facet_rows.unionByName(prob)


# ---------------------------------------------------------------------------
# category statistics
# ---------------------------------------------------------------------------
def category_counts(df: DataFrame) -> DataFrame:
    """Listings per category (a listing counts once per category it carries)."""
    cats = F.coalesce(F.col("categories"), F.array().cast("array<string>"))
    return (df.select(F.col("ord").cast("long").alias("ord"), F.explode(cats).alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")))


def category_percentages(counts: DataFrame, total) -> DataFrame:
    """N / total * 100, 0 when total <= 0 (``total`` is an int or a column)."""
    t = total if not isinstance(total, (int, float)) else F.lit(total)
    return counts.withColumn(
        "pct", F.when(t > 0, F.col("n").cast("double") / t * 100.0).otherwise(F.lit(0.0)))


def match_split(labelled: DataFrame) -> DataFrame:
    """Labelled, matches, excellent and good counts (one row)."""
    cats = F.coalesce(F.col("categories"), F.array().cast("array<string>"))
    return labelled.agg(
        F.count(F.lit(1)).alias("labelled"),
        F.count_if(C.is_match(cats)).alias("matches"),
        F.count_if(C.is_match(cats) & F.array_contains(cats, S.CATEGORY_EXCELLENT)).alias("excellent"),
        F.count_if(C.is_match(cats) & F.array_contains(cats, S.CATEGORY_GOOD)).alias("good"),
    )


def display_groups(df: DataFrame) -> DataFrame:
    """Each listing in its best display group; rows with none of the three left out."""
    return with_display_category(df).where(F.col("display_category").isNotNull()).groupBy(
        "display_category").agg(F.count(F.lit(1)).alias("n"))


def with_display_category(df: DataFrame) -> DataFrame:
    cats = F.coalesce(F.col("categories"), F.array().cast("array<string>"))
    expr = F.lit(None).cast("string")
    for cat in reversed(S.CATEGORIES):
        expr = F.when(F.array_contains(cats, cat), F.lit(cat)).otherwise(expr)
    return df.withColumn("display_category", expr)


def failures_by_error_type(failed: DataFrame) -> DataFrame:
    """Failed rows per error type (missing -> UNKNOWN) with the group size."""
    et = F.coalesce(F.col("error_type"), F.lit("UNKNOWN"))
    groups = failed.groupBy(et.alias("error_type")).agg(F.count(F.lit(1)).alias("group_size"))
    # one row per error type; AQE decides how to join it
    return failed.withColumn("error_type", et).join(groups, "error_type")
