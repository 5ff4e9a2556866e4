"""Keyed store as a Parquet table partitioned by a hash of the ref.

``<root>/listings`` holds the rows in ``bucket=<n>`` folders, ``<root>/meta`` one row a save
(the newest one counts).  A merge reads the buckets its refs fall into and ``save_touched``
overwrites just those (``partitionOverwriteMode=dynamic``), so a save costs what it touches;
``save_store`` replaces the whole table.  The number of buckets is set by the first save.

Spark puts the new folders of a dynamic overwrite in place when its job commits, one after
the other: readers should not run at that moment, and a driver lost in the middle leaves some
buckets new and some old.  Merging the same batch again gives the same store, so the run is
simply repeated; a folder lost between Spark's delete and rename is still in its staging folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listforge import schemas as S
from listforge.session import materialize

BUCKETS = 64
_META = T.StructType([*S.STORE_META.fields, T.StructField("buckets", T.IntegerType()),
                      T.StructField("save", T.LongType()), T.StructField("tag", T.StringType())])
_ROWS = T.StructType([*S.STORE.fields, T.StructField("bucket", T.IntegerType())])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jpath, jvm


def _path(root: str, part: str) -> str:
    return f"{root.rstrip('/')}/{part}"


def bucket_of(ref: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ref), F.lit(buckets)).cast("int")


def load_metadata(spark: SparkSession, root: str) -> dict | None:
    """The row of the newest save (with its number, ``save``, from 1), or None without a store."""
    fs, jpath, _ = _fs(spark, _path(root, "meta"))
    if not fs.exists(jpath):
        return None
    rows = spark.read.schema(_META).parquet(_path(root, "meta")).orderBy(F.desc("save")).limit(1).collect()
    return rows[0].asDict() if rows else None


def save_number(spark: SparkSession, root: str) -> int:
    """How often the store was saved; 0 without a store."""
    return (load_metadata(spark, root) or {"save": 0})["save"]


def store_exists(spark: SparkSession, root: str) -> bool:
    return load_metadata(spark, root) is not None


def load_store(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """A3: the stored listings (of the given buckets only), or an empty store when none exists."""
    return stored_rows(spark, root, buckets).select(*S.STORE.fieldNames())


def stored_rows(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """``load_store`` with the bucket column."""
    if not store_exists(spark, root):
        return spark.createDataFrame([], _ROWS)
    rows = spark.read.schema(_ROWS).parquet(_path(root, "listings"))
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def touched_buckets(spark: SparkSession, root: str, refs: DataFrame, ref_col: str = "ref_id") -> list[int]:
    """The buckets that the refs fall into (at most as many numbers as the store has buckets)."""
    n = (load_metadata(spark, root) or {"buckets": BUCKETS})["buckets"]
    rows = refs.where(F.coalesce(F.col(ref_col), F.lit("")) != "").select(bucket_of(F.col(ref_col), n).alias("b"))
    return sorted(r["b"] for r in rows.distinct().collect())


def find_listing(spark: SparkSession, root: str, ref_id: str) -> DataFrame:
    """B15 on the stored table: one bucket is listed, and its row groups are skipped by the ref."""
    meta = load_metadata(spark, root)
    if meta is None:
        return spark.createDataFrame([], S.STORE)
    rows = spark.read.schema(_ROWS).parquet(_path(root, "listings"))
    ref = F.lit(ref_id)
    bucket = spark.range(1).select(bucket_of(ref, meta["buckets"])).first()[0]
    return rows.where((F.col("bucket") == bucket) & (F.col("ref_id") == ref)).select(*S.STORE.fieldNames())


def _bucketed(store: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together in files of about the advisory size."""
    rows = store.select(*S.STORE.fieldNames()).withColumn("bucket", bucket_of(F.col("ref_id"), buckets))
    return rows.hint("rebalance", F.col("bucket"))


def _record(spark: SparkSession, root: str, metadata, previous: dict | None, buckets: int, tag: str | None) -> int:
    if callable(metadata):
        written = spark.read.schema(_ROWS).parquet(_path(root, "listings"))
        metadata = metadata(written)
    save = (previous or {"save": 0})["save"] + 1
    metadata.select(*S.STORE_META.fieldNames(), F.lit(buckets).cast("int").alias("buckets"),
                    F.lit(save).cast("long").alias("save"), F.lit(tag).cast("string").alias("tag")
                    ).coalesce(1).write.mode("append").parquet(_path(root, "meta"))
    return save


def save_store(spark: SparkSession, root: str, store: DataFrame, metadata, buckets: int = BUCKETS,
               tag: str | None = None) -> int:
    """A4: replace the whole store; returns the number of the save.

    ``metadata`` is the one-row STORE_META frame, or a function that makes it from the written
    rows.  The rows are written aside first, since ``store`` may read the table it replaces.
    """
    known = load_metadata(spark, root)
    buckets = known["buckets"] if known else buckets
    rows = _bucketed(store, buckets)
    if known:
        rows = _bucketed(materialize(store.select(*S.STORE.fieldNames()), "store-next"), buckets)
    # the table is replaced whatever the session's overwrite mode is
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(
        _path(root, "listings"))
    return _record(spark, root, metadata, known, buckets, tag)


def save_touched(spark: SparkSession, root: str, rows: DataFrame, metadata, tag: str | None = None) -> int:
    """A4 for a merge: overwrite only the buckets that ``rows`` fall into.

    ``rows`` must hold all next rows of those buckets.  The first save makes the store.
    """
    known = load_metadata(spark, root)
    if known is None:
        return save_store(spark, root, rows, metadata, tag=tag)
    _bucketed(rows, known["buckets"]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(_path(root, "listings"))
    return _record(spark, root, metadata, known, known["buckets"], tag)


def was_saved(spark: SparkSession, root: str, tag: str) -> bool:
    """Whether a save with this tag is recorded (a replayed micro-batch asks)."""
    return store_exists(spark, root) and not spark.read.schema(_META).parquet(
        _path(root, "meta")).where(F.col("tag") == tag).isEmpty()
