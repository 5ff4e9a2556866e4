"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.llm import page_graph
from listforge.llm.common import table


def op4_page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = page_graph.main_text(pages, page_graph.train(pages))
    return found.select("page_id", "url", F.col("_text").alias("text"),
                        F.length("_text").cast("long").alias("n_chars"))


QUERIES = {"op4_page_graph": op4_page_graph}
ORACLE: dict[str, str] = {}
