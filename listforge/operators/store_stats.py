"""Extraction statistics kept with the store (E5-E10, E12, E22 without a pass over all listings).

``<root>/stats`` holds the mergeable partials (``stats.stat_partials``) of every bucket of
the store.  After a save only the buckets it touched are counted again, from columns without
texts; any statistic is then taken from the partials, a table of facet combinations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listforge.operators import stats as STS
from listforge.sources import store_io as IO

_STATS = T.StructType([
    *[T.StructField(c, T.BooleanType() if c == "success" else T.StringType()) for c in STS.FACETS],
    *[T.StructField(c, T.LongType()) for c in ("stat_n", "first_ord", "chars", "chars_zero", "chars_min", "chars_max")],
    T.StructField("has_details", T.BooleanType()), T.StructField("bucket", T.IntegerType())])


def bucket_partials(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """The partials of the stored listings of these buckets (None: all), by bucket.

    A listing's order is the microsecond it was first seen.  Listings without details are
    counted apart (``has_details``), so a bucket that has lost its details is still rewritten.
    """
    rows = IO.stored_rows(spark, root, buckets).select(
        "bucket", F.unix_micros("first_seen").alias("ord"), "details", F.col("details").isNotNull().alias("has_details"))
    view = STS.details_view(rows, "bucket", "has_details")
    return STS.stat_partials(view.withColumnRenamed("n", "stat_n"), "has_details", "bucket")


def refresh_stats(spark: SparkSession, root: str, buckets: list[int] | None = None) -> None:
    """Count these buckets again (after ``save_touched``), or all of them."""
    out = bucket_partials(spark, root, buckets).select(*_STATS.fieldNames())
    mode = "static" if buckets is None else "dynamic"
    out.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(
        "bucket").parquet(f"{root.rstrip('/')}/stats")


def store_partials(spark: SparkSession, root: str) -> DataFrame:
    """The partials of all listings with details, as the statistics take them."""
    rows = spark.read.schema(_STATS).parquet(f"{root.rstrip('/')}/stats").where("has_details")
    return STS.stat_partials(rows.drop("has_details", "bucket"))
