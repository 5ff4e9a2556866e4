"""A local session without spark.checkpoint.dir still gets a checkpoint folder."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')
     .config('spark.ui.showConsoleProgress', 'false').getOrCreate())
assert s.conf.get('spark.checkpoint.dir', None) is None
from listforge.session import ensure_checkpoint_dir, materialize
from listforge.operators.indexing import global_index
assert ensure_checkpoint_dir(s)
assert materialize(s.range(5), 'x').count() == 5
got = [r[0] for r in global_index(s.range(7), ['id'], 'i').orderBy('id').select('i').collect()]
assert got == list(range(7)), got
print('FALLBACK-OK')
"""


def test_local_fallback_without_setting():
    env = dict(os.environ, SPARK_CONF_DIR=tempfile.mkdtemp(prefix="listforge-noconf-"))
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True,
                         timeout=600)
    assert "FALLBACK-OK" in out.stdout, out.stderr[-2000:]


def test_release_scratch_deletes_what_was_made(spark):
    from listforge import session

    session.release_scratch(spark)
    df = session.materialize(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(fs_path)
    assert session.release_scratch(spark) == 1
    assert not fs.exists(fs_path)


def test_a_cluster_keeps_its_shuffle_partitions(monkeypatch):
    from unittest.mock import MagicMock

    from pyspark.sql import SparkSession

    from listforge import session

    seen = {}

    class Builder:
        def __getattr__(self, name):
            if name == "getOrCreate":
                return MagicMock
            return lambda *a: (seen.update([a]) if name == "config" else None) or self

    monkeypatch.setattr(SparkSession, "builder", Builder())
    monkeypatch.delenv("LISTFORGE_SHUFFLE_PARTITIONS", raising=False)
    session.build_session()
    assert "spark.sql.shuffle.partitions" not in seen
    session.build_session("local[2]")
    assert seen["spark.sql.shuffle.partitions"] == "8"
