"""Landed HTML pages (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from listforge import schemas as S

LANDED = T.StructType([*S.PAGE.fields, T.StructField("http_status", T.IntegerType())])


def load_html_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A5: page_id, url, html and http_status of a Parquet corpus, with an explicit schema.

    A corpus without ``http_status`` has it null, which counts as fetched; another status
    than 200 becomes a failure row without a warning when the pages are extracted.
    """
    return spark.read.schema(LANDED).parquet(path)
