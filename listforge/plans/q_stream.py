"""Queries for the streaming jobs.

T1 binding: the events change feed of ``q_store`` lands as two groups of files
(events before the cut-off, then the later ones); each group is one
micro-batch, merged with the same queries and dates as the two batch merges,
so the final store must equal ``merge_listings``.
"""

from pyspark.sql import functions as F

from listforge.plans import bindings as B
from listforge.plans import q_extract as QX
from listforge.plans import q_store as QS
from listforge.plans.registry import ORACLE, register
from listforge.session import scratch_path
from listforge.sources import store_io as IO
from listforge.streaming.extract_stream import stream_extract
from listforge.streaming.merge_stream import stream_merge

_LISTING_COLS = ["ref_id", "title", "employer", "location", "external_url", "modified_at",
                 "published_on", "batch_ord"]


@register("stream_merge", ORACLE["merge_listings"])
def q_stream_merge(spark, sf):
    """Two runs of one stream, each merging the group of files that has landed by then."""
    ev = QS.event_listings(spark, sf)
    cut = F.lit(QS.CUT).cast("timestamp")
    landing, store_root = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-store")
    checkpoint = scratch_path(spark, "stream-ckpt")
    groups = [(F.col("ts") < cut, QS.Q1, QS.AS_OF_1), (F.col("ts") >= cut, QS.Q2, QS.AS_OF_2)]
    for landed, query, as_of in groups:
        ev.where(landed).select(*_LISTING_COLS).write.mode("append").parquet(landing)
        stream_merge(spark, landing, store_root, checkpoint, query, B.PLACE, B.RADIUS_KM, as_of)
    return QS.store_view(IO.load_store(spark, store_root))


@register("stream_extract", f"""
WITH {QX._DETAILS} SELECT page_id, success, method, warning, text_length FROM page_details""")
def q_stream_extract(spark, sf):
    """The `pages` table landed as files, extracted by a stream."""
    landing = scratch_path(spark, "pages-in")
    B.table(spark, sf, "pages").write.mode("overwrite").parquet(landing)
    out = scratch_path(spark, "pages-out")
    stream_extract(spark, landing, out, scratch_path(spark, "pages-ckpt"))
    return spark.read.parquet(out).select("page_id", "details.success", "details.method",
                                          "details.warning", "details.text_length")
