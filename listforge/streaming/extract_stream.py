"""Stateless extraction of HTML pages landing in a directory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from listforge import schemas as S
from listforge.functions.page_text import DEFAULT_OPTIONS, ExtractOptions
from listforge.operators.extract import extract_corpus


def stream_extract(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                   options: ExtractOptions = DEFAULT_OPTIONS, max_files_per_trigger: int | None = None,
                   available_now: bool = True):
    reader = spark.readStream.schema(S.PAGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    out = extract_corpus(reader.parquet(in_dir), options)
    writer = (out.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer
    handle = writer.start()
    if available_now:
        handle.awaitTermination()
    return handle
