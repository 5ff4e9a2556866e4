"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "listforge") -> SparkSession:
    """A session tuned for this workload; on a cluster pass master=None.

    The number of shuffle partitions is the cluster's business: it is set here only when
    given, or for a local master.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("LISTFORGE_SHUFFLE_PARTITIONS")
    if parts is None and (master or "").startswith("local"):
        parts = 8
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HTML pages are wide rows: keep Arrow batches small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it on the context if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value is
    always used.  Only a local session (tests, local bench) without the setting
    gets its own scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared checkpoint folder")
    # local only (tests, local bench); the core setting itself cannot change at runtime
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="listforge-ckpt-"))
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders made since the last call; returns how many were there.

    To be called when the results that were built on them are written.
    """
    gone = 0
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``listforge`` importable in Python workers (once per SparkContext).

    Python-backed operators (``mapInPandas``) unpickle functions that reference
    this package.  The package is zipped in memory, written under the shared
    checkpoint folder and added with ``addPyFile``, so every executor fetches the
    same file.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import hashlib
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirs, files in sorted(os.walk(pkg_dir)):
            dirs.sort()
            if "__pycache__" in dirpath:
                continue
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, root))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:16]
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/code/{digest}/listforge.zip"
    jvm = sc._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(target)
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        out = fs.create(jpath, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like a reliable checkpoint, but in one job (a checkpoint of an
    uncached plan computes it twice) and columnar.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
