"""Dense global row numbers without a single-partition window.

A plain ``row_number().over(Window.orderBy(...))`` moves every row into one
task.  Here rows are range-partitioned on the order, sorted inside each
partition and numbered locally; per-partition counts (one row per partition,
so their size is bounded by the partition count) give each partition its
offset, which is broadcast back.  The ranged input (with its partition id and position columns) is written
once to the shared checkpoint folder first, so those values stay fixed if a task
is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listforge.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def global_index(df: DataFrame, order_cols: list, name: str = "row_idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the total order ``order_cols``.

    ``order_cols`` must make the order total (end with a unique key).
    """
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else \
        df.repartitionByRange(*cols)
    ranged = (ranged.sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    # fixes partition ids and in-partition positions as written columns
    ranged = materialize(ranged, "ranged-index")
    # per-partition sizes: one small row per partition (what zipWithIndex collects too)
    sizes = sorted((r["_pid"], r["_n"]) for r in
                   ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets_rows, running = [], 0
    for pid, n in sizes:
        offsets_rows.append((pid, running))
        running += n
    offsets = spark.createDataFrame(offsets_rows, "_pid int, _off long")
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local).cast("long"))
            .drop("_pid", "_mono", "_off"))


def row_positions(df: DataFrame, order_cols: list[str], name: str = "row_idx") -> DataFrame:
    """``global_index`` for wide rows: only the order columns are sorted and written.

    Distinct keys are numbered with room for their rows, and the rows are joined to their
    key; rows of equal keys follow a hash of the row.  Join and window go by the same column
    (a struct, so null keys are equal): the wide rows are shuffled once.
    """
    spark = df.sparkSession
    keys = list(order_cols)
    ranged = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*keys)
              .sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "ranged-keys")
    sizes = sorted((r["_pid"], r["_n"]) for r in ranged.groupBy("_pid").agg(F.sum("_n").alias("_n")).collect())
    rows, total = [], 0
    for pid, n in sizes:  # one row per partition
        rows.append((pid, total))
        total += n
    offsets = spark.createDataFrame(rows, "_pid int, _off long")
    before = Window.partitionBy("_pid").orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(
        F.broadcast(offsets), "_pid").select(F.struct(*keys).alias("_key"), (F.col("_at") + F.col("_off")).alias("_at"))
    inside = Window.partitionBy("_key").orderBy(F.xxhash64(*df.columns))
    return (df.withColumn("_key", F.struct(*keys)).join(start, "_key")
            .withColumn(name, (F.col("_at") + F.row_number().over(inside) - 1).cast("long")).drop("_key", "_at"))


def running_sum(df: DataFrame, part_cols: list[str], order_col: str, value_col: str,
                name: str = "running", chunk_size: int = 1 << 16) -> DataFrame:
    """Exact inclusive running sum of ``value_col`` per ``part_cols`` ordered by ``order_col``.

    Two levels, so one huge partition key is still spread over many tasks:
    a window inside (key, order chunk) and the chunk totals carried forward
    over a table with one row per (key, chunk).  ``order_col`` must be an
    integer column that is unique within a key.
    """
    keys = list(part_cols)
    chunk = F.floor(F.col(order_col) / F.lit(chunk_size)).cast("long")
    s = df.withColumn("_rs_chunk", chunk)
    w_local = Window.partitionBy(*keys, "_rs_chunk").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = s.withColumn("_rs_local", F.sum(value_col).over(w_local))
    totals = s.groupBy(*keys, "_rs_chunk").agg(F.sum(value_col).alias("_rs_total"))
    w_chunks = Window.partitionBy(*keys).orderBy("_rs_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_rs_chunk",
                          F.coalesce(F.sum("_rs_total").over(w_chunks), F.lit(0)).alias("_rs_carry"))
    return (local.join(carry, keys + ["_rs_chunk"], "left")
            .withColumn(name, F.col("_rs_local") + F.coalesce("_rs_carry", F.lit(0)))
            .drop("_rs_chunk", "_rs_local", "_rs_carry"))
