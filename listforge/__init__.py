"""listforge: incremental text-listing pipeline on Spark DataFrames.

Sub-packages:
    sources    readers and writers (landed pages, HTML corpus, keyed store, sinks)
    functions  column expressions and the per-page HTML helper used inside tasks
    operators  DataFrame -> DataFrame operators (filters, extraction, merge,
               batching, labelling, statistics, reports)
    plans      compositions (gather, full run) and bindings to the driver tables
    streaming  Structured Streaming jobs over landing directories
"""

from listforge.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
