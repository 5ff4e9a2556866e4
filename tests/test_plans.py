"""Plan checks: pushed filters, no wide columns in statistics shuffles, ranged indexing."""

import re

from listforge.operators import filters as FL
from listforge.operators import labels as L
from listforge.operators import stats as ST
from listforge.plans import bindings as B

SF = "/root/testdata/sf0.001"


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchange_inputs(plan_text):
    """Input column lists of every Exchange node in a formatted plan."""
    blocks = re.split(r"\n\(\d+\) ", plan_text)
    return [b for b in blocks if b.startswith("Exchange")]


def test_recency_filter_is_pushed(spark):
    orders = B.table(spark, SF, "orders")
    plan = formatted(FL.published_within(orders, "2001-08-01", 100, "o_orderdate"))
    assert re.search(r"PushedFilters: \[IsNotNull\(o_orderdate\), GreaterThanOrEqual\(o_orderdate,", plan)


def test_statistics_never_shuffle_text(spark):
    docs = B.doc_listings(spark, SF)
    for df in (ST.stats_by_domain(docs), ST.stats_by_source(docs), ST.extraction_report(docs)):
        for block in exchange_inputs(formatted(df)):
            assert "text" not in re.sub(r"text_length", "", block), block
        assert "ReadSchema" in formatted(df)


def test_batch_plan_uses_range_partitioning(spark):
    docs = B.table(spark, SF, "documents").select("doc_id", "text")
    plan = L.assign_batches(docs, 70, ["doc_id"])
    text = formatted(plan)
    # the rows are numbered per range partition; only the per-partition count table
    # (one row per partition) meets a global window
    # numbered from the materialised, range-partitioned rows; offsets are broadcast,
    # so no step gathers rows into a single partition
    assert "ranged-keys" in text
    assert "SinglePartition" not in text
    assert plan.select("batch_no").distinct().count() == -(-docs.count() // 70)


def test_top_examples_limit_is_applied_before_the_shuffle(spark):
    from listforge.operators import report as RP

    df = RP.top_examples(B.labelled_listings(spark, SF), 3, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_merge_ordered_step_has_no_global_window(spark):
    from pyspark.sql import functions as F

    from listforge.operators import store as ST

    keys = B.table(spark, SF, "events").select(
        F.col("user_id").cast("string").alias("ref_id"), F.col("event_id").alias("ord"),
        F.col("event_type").alias("stamp"), F.lit(False).alias("is_store"))
    plan = ST.prior_stamps(keys)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "hashpartitioning(ref_id" in plan


def test_the_report_reads_what_it_wrote(spark):
    from pyspark.sql import functions as F

    from listforge.functions import columns as C
    from listforge.operators import report as RP

    docs, labelled = B.doc_listings(spark, SF), B.labelled_listings(spark, SF)
    plan = formatted(RP.market_report(docs, labelled, C.is_match("categories")))
    scans = [b for b in re.split(r"\n\(\d+\) ", plan) if b.startswith("Scan parquet")]
    assert 1 <= len(scans) <= 4 and all("report-" in b for b in scans)
    assert "documents.parquet" not in plan and "text" not in "".join(re.findall(r"ReadSchema: (.*)", plan))
    # a single partition gets rows per label or per facet value, never listings
    for block in exchange_inputs(plan):
        assert "SinglePartition" not in block or "ord#" not in re.sub(r"first_ord#", "", block), block
    dash = formatted(RP.run_dashboard(docs, F.col("details.success"), labelled, C.is_match("categories")))
    assert len(re.findall(r"\n\(\d+\) Scan parquet", dash)) == 3


def test_the_report_of_nothing(spark):
    from listforge.functions import columns as C
    from listforge.operators import report as RP

    docs, labelled = B.doc_listings(spark, SF).where("false"), B.labelled_listings(spark, SF).where("false")
    rows = RP.market_report(docs, labelled, C.is_match("categories")).collect()
    assert {(r["section"], r["key"], r["n"]) for r in rows} == {
        ("totals", k, 0) for k in ("total_found", "extracted", "labelled", "returned", "failures")}
