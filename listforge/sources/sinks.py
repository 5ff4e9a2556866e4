"""Sinks (A6-A8, A10, A11): distributed writes, no driver-side row loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.functions.columns import category_priority
from listforge.operators import stats as ST


def write_ranked_csv(labelled: DataFrame, path: str, keep_order: bool = False) -> None:
    """Title, city, employer, joined categories, url; ranked by G1 unless ``keep_order``.

    The sort is a range-partitioned ``orderBy``, so part files are in rank order.
    """
    df = labelled
    cats = F.array_join(F.coalesce(F.col("categories"), F.array().cast("array<string>")), ", ")
    if "city" not in df.columns and "location" in df.columns:
        df = df.withColumn("city", F.col("location.city"))
    out = df.select(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("employer", F.lit("")).alias("employer"), cats.alias("categories"),
        F.coalesce("url", F.lit("")).alias("url"),
        category_priority("categories").alias("_prio"), F.lower(F.coalesce("title", F.lit(""))).alias("_title"),
        F.col("ord"))
    order = ["ord"] if keep_order else ["_prio", "_title", "ord"]
    (out.orderBy(*order).drop("_prio", "_title", "ord")
     .write.mode("overwrite").option("header", True).csv(path))


def write_failed_csv(failed: DataFrame, path: str) -> None:
    """Failures with their error type (missing -> UNKNOWN)."""
    out = failed.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "city", "employer", "url")],
        F.coalesce("error_type", F.lit("UNKNOWN")).alias("error_type"))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Labelled rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_scraped(df: DataFrame, path: str, run_id: str) -> None:
    """A10: extraction output incl. failures, one folder per run (dynamic overwrite)."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id") \
            .parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def write_error_report(details: DataFrame, path: str) -> bool:
    """Failure tables (by warning, top-10 domains, details) when there is a failure."""
    failed_any = details.where(~F.coalesce(F.col("details.success"), F.lit(False))).limit(1)
    if failed_any.isEmpty():
        return False
    ST.failures_by_warning(details).write.mode("overwrite").json(f"{path}/by_warning")
    ST.failures_by_domain_top(details, 10).write.mode("overwrite").json(f"{path}/by_domain")
    ST.failure_details(details).write.mode("overwrite").json(f"{path}/failed")
    return True


__all__ = ["write_ranked_csv", "write_failed_csv", "write_json", "write_scraped",
           "write_error_report"]
