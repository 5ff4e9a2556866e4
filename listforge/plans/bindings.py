"""Bindings of the pipeline's roles to the driver tables.

Each Spark binding has a DuckDB twin in ``plans.oracle`` with the same rules.
Bindings assign roles (which column plays the ref, the text, the domain ...);
they never drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge import schemas as S

INTERNAL_BASE_URL = "https://jobs.example.org/detail"
STORE_CUTOFF = "2024-01-16 00:00:00"
AS_OF = "2024-02-01 00:00:00"
PLACE = "Berlin"
RADIUS_KM = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as extracted listings: ref = doc_id, employer = source, city = lang.

    Extraction outcome: success when n_chars >= 1000; internal pages where
    doc_id % 5 = 0 (role assignment, every row kept); domain = source.
    """
    d = table(spark, sf_dir, "documents")
    ok = F.col("n_chars") >= S.MIN_VALID_TEXT_LENGTH
    internal = (F.col("doc_id") % 5) == 0
    ext_url = F.when(~internal, F.concat(F.lit("https://"), F.col("source"),
                                         F.lit(".example.org/jobs/"), F.col("doc_id").cast("string")))
    page_url = F.when(internal, F.concat(F.lit(INTERNAL_BASE_URL + "/"),
                                         F.col("doc_id").cast("string"))).otherwise(ext_url)
    details = F.struct(
        ok.alias("success"),
        F.col("text").alias("text"),
        page_url.alias("url"),
        F.when(internal, F.lit(S.SOURCE_INTERNAL)).otherwise(F.lit(S.SOURCE_EXTERNAL)).alias("source"),
        F.when(ok, F.lit(S.METHOD_CSS)).otherwise(F.lit(S.METHOD_FALLBACK)).alias("method"),
        F.col("n_chars").cast("long").alias("text_length"),
        F.col("source").alias("domain"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(S.WARN_SHORT_CONTENT)).alias("warning"),
        F.when(ok, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("Insufficient content ("), F.col("n_chars").cast("string"),
                     F.lit(" chars)"))).alias("error"),
    )
    return d.select(
        F.col("doc_id").cast("long").alias("ord"),
        F.col("doc_id").cast("string").alias("ref_id"),
        F.concat_ws(" ", F.col("lang"), F.col("source")).alias("title"),
        F.col("source").alias("employer"),
        F.struct(F.col("lang").alias("city")).alias("location"),
        ext_url.alias("external_url"),
        details.alias("details"),
    )


def label_category(quality, toxic):
    return (F.when((quality == 1) & (toxic == 0), F.lit(S.CATEGORY_EXCELLENT))
            .when(quality == 1, F.lit(S.CATEGORY_GOOD))
            .otherwise(F.lit(S.CATEGORY_POOR)))


def labelled_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted document listings that carry a label (documents joined with labels)."""
    docs = doc_listings(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, docs["ord"] == labels["doc_id"], "inner").select(
        "ord", "ref_id", "title", "employer", "location", "external_url", "details",
        F.array(label_category(F.col("quality"), F.col("toxic"))).alias("categories"),
    )
