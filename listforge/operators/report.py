"""Rankings, summaries and the report table.

Single-row summaries are built as aggregates in Spark (several one-row
aggregates are stacked and folded with ``max``) or observed during a write, never from
driver loops.
Orders that the studied pipeline took from dict insertion order are made
explicit with first-appearance keys.  Global windows are only used on tables
whose size is bounded by the label set (a handful of rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.functions import columns as C
from listforge.operators import stats as ST
from listforge.operators.indexing import row_positions
from listforge.session import materialize


def pct(n: Column, total: Column) -> Column:
    """n / total * 100, 0 when the total is not positive (K10: no division by zero)."""
    return F.when(total > 0, n.cast("double") / total * 100.0).otherwise(F.lit(0.0))


def fold_rows(*frames: DataFrame) -> DataFrame:
    """Combine one-row frames with disjoint columns into one row."""
    cols = [c for f in frames for c in f.columns]
    aligned = []
    for f in frames:
        aligned.append(f.select(*[F.col(c) if c in f.columns else F.lit(None).alias(c)
                                  for c in cols]))
    typed = []
    for f in aligned:
        typed.append(f.select(*[F.col(c).cast(_type_of(frames, c)).alias(c) for c in cols]))
    out = typed[0]
    for f in typed[1:]:
        out = out.unionByName(f)
    return out.agg(*[F.max(c).alias(c) for c in cols])


def _type_of(frames, col):
    for f in frames:
        if col in f.columns:
            return f.schema[col].dataType
    raise KeyError(col)


# ---------------------------------------------------------------------------
# G1 / G2 / G3 / G4 / F4
# ---------------------------------------------------------------------------
def rank_listings(df: DataFrame) -> DataFrame:
    """G1: best category priority, then lower-cased title, then arrival; adds dense ``rank``."""
    keyed = df.withColumn("_prio", C.category_priority("categories")).withColumn(
        "_title", F.lower(F.coalesce(F.col("title"), F.lit(""))))
    ranked = row_positions(keyed, ["_prio", "_title", "ord"], name="rank")
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_prio", "_title")


def categories_by_count(df: DataFrame) -> DataFrame:
    """Category counts, most first, first-seen first on ties (``rank`` from 1)."""
    counts = ST.category_counts(df)
    # one row per distinct label: a tiny table
    w = Window.orderBy(F.desc("n"), F.asc("first_ord"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))


def ranked_counts(counts: DataFrame, name_col: str) -> DataFrame:
    """Counts, most first, then by name (``rank`` from 1); bounded enumerations only."""
    w = Window.orderBy(F.desc("n"), F.asc(name_col))
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))


def top_categories(df: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent categories."""
    return ST.category_counts(df).orderBy(F.desc("n"), F.asc("first_ord")).limit(k)


def top_examples(df: DataFrame, k: int = 3, per_category: int = 3) -> DataFrame:
    """the first ``per_category`` listings (arrival order) of each of the top k categories.

    ``row_number() <= n`` lets Spark keep only n rows per category before the
    shuffle (window group limit), so a category holding most rows is cut map-side.
    """
    top = top_categories(df, k).select("category", F.col("n").alias("category_n"),
                                       "first_ord")
    cats = F.coalesce(F.col("categories"), F.array().cast("array<string>"))
    url = F.col("url") if "url" in df.columns else F.col("details.url")
    exploded = df.select("ord", "title", F.col("location.city").alias("city"), "employer", url.alias("url"),
                         F.explode(F.array_distinct(cats)).alias("category"))
    # k rows: a size-bounded broadcast
    picked = exploded.join(F.broadcast(top.select("category")), "category", "left_semi")
    w = Window.partitionBy("category").orderBy("ord")
    firsts = picked.withColumn("example_no", F.row_number().over(w)).where(
        F.col("example_no") <= per_category)
    return firsts.join(F.broadcast(top), "category")


# ---------------------------------------------------------------------------
# summaries
# ---------------------------------------------------------------------------
def _counts(whole: DataFrame, part: DataFrame | Column, names: tuple[str, str], *of_part) -> list[DataFrame]:
    """One-row counts of a frame and of a part of it: in one pass if the part is a condition on it.

    ``of_part`` are (name, condition) counts inside the part.
    """
    def count_if(condition):
        return F.count_if(F.coalesce(condition, F.lit(False)))

    if isinstance(part, Column):
        return [whole.agg(F.count(F.lit(1)).alias(names[0]), count_if(part).alias(names[1]),
                          *[count_if(part & c).alias(n) for n, c in of_part])]
    return [whole.agg(F.count(F.lit(1)).alias(names[0])),
            part.agg(F.count(F.lit(1)).alias(names[1]), *[count_if(c).alias(n) for n, c in of_part])]


def _label_counts(name=lambda c: c) -> list[tuple[str, Column]]:
    cats = F.coalesce(F.col("categories"), F.array().cast("array<string>"))
    return [(name(_slug(c)), F.array_contains(cats, c)) for c in S.CATEGORIES]


def run_dashboard(total_found: DataFrame, extracted: DataFrame | Column, labelled: DataFrame,
                  returned: DataFrame | Column) -> DataFrame:
    """Totals and rates of one run, and the returned rows of each label (one row).

    ``extracted`` may be a condition on ``total_found`` and ``returned`` one on ``labelled``;
    each pair then takes one pass.  ``match_rate`` is only given when filtering removed rows
    (labelled > returned).
    """
    row = fold_rows(*_counts(total_found, extracted, ("total_found", "extracted")),
                    *_counts(labelled, returned, ("labelled", "returned"), *_label_counts(lambda c: f"n_{c}")))
    return _dashboard(row)


def _dashboard(row: DataFrame) -> DataFrame:
    """The rates of one row of counts."""
    t = F.col("total_found")
    return row.select(
        "total_found", "extracted", pct(F.col("extracted"), t).alias("extract_rate"),
        "labelled", pct(F.col("labelled"), t).alias("label_rate"),
        "returned",
        F.when(F.col("labelled") > F.col("returned"), pct(F.col("returned"), F.col("labelled")))
        .alias("match_rate"),
        (t - F.col("extracted")).alias("failures"),
        pct(t - F.col("extracted"), t).alias("failure_rate"),
        *[c for c in row.columns if c.startswith("n_")],
    )


def basic_statistics(labelled: DataFrame, total: int | Column, successful: int | Column):
    """Coverage and the category table ordered by count (pct of the given total)."""
    t = F.lit(total) if isinstance(total, int) else total
    s = F.lit(successful) if isinstance(successful, int) else successful
    table = ST.category_percentages(ST.category_counts(labelled), t)
    return table.withColumn("coverage", pct(s, t))


def run_summary(found: DataFrame, extracted: DataFrame | Column, returned: DataFrame) -> DataFrame:
    """Totals, extracted %, returned %, per-category % of returned (one row)."""
    counts = returned.agg(F.count(F.lit(1)).alias("returned"), *[F.count_if(c).alias(n) for n, c in _label_counts()])
    row = fold_rows(*_counts(found, extracted, ("total", "extracted")), counts)
    r = F.col("returned")
    return row.select(
        "total", "extracted", pct(F.col("extracted"), F.col("total")).alias("extracted_pct"),
        "returned", pct(r, F.col("total")).alias("returned_pct"),
        *[pct(F.col(_slug(cat)), r).alias(_slug(cat) + "_pct") for cat in S.CATEGORIES],
    )


def _slug(cat: str) -> str:
    return cat.lower().replace(" ", "_")


def market_report(found: DataFrame, labelled: DataFrame, returned: Column,
                  examples_per_category: int = 3) -> DataFrame:
    """The report as rows (section, ord, key, n, value, detail).

    Sections: totals (counts, and coverage rates in ``value``), extraction (E22), categories
    (count and % of all found) and examples (top 3 categories, the first listings of each
    with employer and URL).

    ``found`` holds the listings with ``details``, read once into ``stat_partials``; ``returned``
    is a condition on ``labelled``, of which the returned rows are written once without texts.
    The totals are observed during those two writes; the report itself reads only what they
    wrote.
    """
    spark, k = found.sparkSession, 3
    seen, kept = Observation(), Observation()
    view = ST.details_view(found).observe(seen, F.count(F.lit(1)).alias("total_found"),
                                          F.count_if("success").alias("extracted"))
    partials = materialize(ST.stat_partials(view.withColumnRenamed("n", "stat_n")), "report-partials")
    is_returned = F.coalesce(returned, F.lit(False))
    cats = F.array_distinct(F.coalesce(F.col("categories"), F.array().cast("array<string>")))
    url = F.col("url") if "url" in labelled.columns else F.col("details.url")
    rows = labelled.select(F.col("ord").cast("long").alias("ord"), "title", F.col("location.city").alias("city"), "employer",
                           url.alias("url"), cats.alias("categories"), is_returned.alias("returned"))
    rows = rows.observe(kept, F.count(F.lit(1)).alias("labelled"), F.count_if("returned").alias("returned"))
    narrow = materialize(rows.where("returned").drop("returned"), "report-returned")
    total = {n: 0 for n in ("total_found", "extracted", "labelled", "returned")}
    for frame, observed in ((found, seen), (labelled, kept)):
        if not frame.isEmpty():  # the optimizer leaves nothing to observe of an empty frame
            total |= observed.get

    nothing = {"n": F.lit(None).cast("long"), "value": F.lit(None).cast("double"), "detail": F.lit(None).cast("string")}

    def section(name, order, key, **given):
        cols = {c: given.get(c, v) for c, v in nothing.items()}
        return F.struct(F.lit(name).alias("section"), order.cast("long").alias("ord"), key.alias("key"),
                        *[c.alias(n) for n, c in cols.items()])

    # one row of driver numbers, no scan
    dash = _dashboard(spark.range(1).select(*[F.lit(int(v)).cast("long").alias(n) for n, v in total.items()]))
    rates = [("total_found", None), ("extracted", "extract_rate"), ("labelled", "label_rate"),
             ("returned", "match_rate"), ("failures", "failure_rate")]
    totals = dash.select(F.inline(F.array(*[
        section("totals", F.lit(i), F.lit(key), n=F.col(key).cast("long"),
                value=(F.col(rate) if rate else F.lit(None)).cast("double")) for i, (key, rate) in enumerate(rates)])))
    extraction = ST.extraction_report(partials).select(section(
        "extraction", F.lit(0), F.concat_ws(":", "section", "item"), n=F.col("n"), value=F.col("pct"),
        detail=F.col("primary_warning")).alias("r")).select("r.*")
    # per category its count and first listings: a row per label
    each = narrow.select("ord", "title", "city", "employer", "url", F.explode("categories").alias("category"))
    firsts = each.withColumn("no", F.row_number().over(Window.partitionBy("category").orderBy("ord"))).where(
        F.col("no") <= examples_per_category)  # cut map-side by the window group limit
    shown = [F.coalesce(c, F.lit("N/A")) for c in (F.col("title"), F.col("city"), F.col("employer"), F.col("url"))]
    firsts = firsts.select("category", section(
        "examples", F.col("no"), F.concat(F.col("category"), F.lit(": "), shown[0], F.lit(" ("), shown[1], F.lit(")")),
        detail=F.concat_ws(" | ", *shown[2:])).alias("example"))
    firsts = firsts.groupBy("category").agg(F.collect_list("example").alias("examples"))
    counts = ST.category_counts(narrow)
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first_ord"))))
    own = section("categories", F.col("first_ord"), F.col("category"), n=F.col("n"),
                  value=pct(F.col("n"), F.lit(int(total["total_found"]))))
    labels = ranked.join(firsts, "category").select(F.inline(F.when(
        F.col("rank") <= k, F.concat(F.array(own), F.col("examples"))).otherwise(F.array(own))))
    return totals.unionByName(extraction).unionByName(labels)
