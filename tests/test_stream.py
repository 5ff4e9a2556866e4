"""The merge stream equals batch merges and restarts from its checkpoint."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import store as ST
from listforge.session import materialize
from listforge.sources import store_io as IO
from listforge.streaming.extract_stream import stream_extract
from listforge.streaming.merge_stream import save_winners, stream_merge

COLS = [f.name for f in S.LISTING.fields]


def group(spark, rows):
    return spark.createDataFrame(rows, S.LISTING)


def snapshot_rows(df):
    return sorted((r["ref_id"], r["modified_at"], r["title"], r["first_seen"], r["last_seen"],
                   len(r["found_in"])) for r in df.collect())


def test_stream_restart_equals_batches(spark, scratch):
    g1 = [("a", "t1", None, None, None, "1", None, 1), ("b", "t2", None, None, None, "1", None, 2),
          ("a", "t3", None, None, None, "2", None, 3)]
    g2 = [("a", "t4", None, None, None, "2", None, 4), ("c", "t5", None, None, None, "", None, 5),
          ("b", "t6", None, None, None, "3", None, 6)]
    landing, root, ckpt = scratch + "/in", scratch + "/store", scratch + "/ckpt"
    dates = {0: "2024-01-01 00:00:00", 1: "2024-01-02 00:00:00"}
    group(spark, g1).coalesce(1).write.mode("append").parquet(landing)
    stream_merge(spark, landing, root, ckpt, "q", "p", 25, lambda b: dates[b])
    first = IO.save_number(spark, root)
    # restart without new files: nothing changes
    stream_merge(spark, landing, root, ckpt, "q", "p", 25, lambda b: dates[b])
    assert IO.save_number(spark, root) == first == 1
    time.sleep(1.1)
    group(spark, g2).coalesce(1).write.mode("append").parquet(landing)
    stream_merge(spark, landing, root, ckpt, "q", "p", 25, lambda b: dates[b])
    assert IO.save_number(spark, root) == 2
    m1 = ST.merge_listings(ST.empty_store(spark), group(spark, g1), "q", "p", dates[0])
    m2 = ST.merge_listings(m1.store, group(spark, g2), "q", "p", dates[1])
    assert snapshot_rows(IO.load_store(spark, root)) == snapshot_rows(m2.store)


def test_stream_extract(spark, scratch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.write.parquet(scratch + "/pages")
    stream_extract(spark, scratch + "/pages", scratch + "/out", scratch + "/ckpt")
    out = spark.read.parquet(scratch + "/out")
    assert out.count() == pages.count()
    assert out.where(F.col("details.method").isNull()).count() == 0


def test_only_newer_drops_late_older_versions(spark, scratch):
    g1 = [("a", "t1", None, None, None, "2024-01-05", None, 1)]
    g2 = [("a", "late", None, None, None, "2024-01-01", None, 2),
          ("b", "t2", None, None, None, "2024-01-01", None, 3)]
    landing, root = scratch + "/in", scratch + "/store"
    group(spark, g1).coalesce(1).write.mode("append").parquet(landing)
    stream_merge(spark, landing, root, scratch + "/ckpt", "q", "p", 25, "2024-02-01 00:00:00",
                 only_newer=True)
    time.sleep(1.1)
    group(spark, g2).coalesce(1).write.mode("append").parquet(landing)
    stream_merge(spark, landing, root, scratch + "/ckpt", "q", "p", 25, "2024-02-02 00:00:00",
                 only_newer=True)
    got = {r["ref_id"]: r["title"] for r in IO.load_store(spark, root).collect()}
    assert got == {"a": "t1", "b": "t2"}


def test_new_checkpoint_on_an_old_store_loses_nothing(spark, scratch):
    root = scratch + "/store"
    for n, ref in enumerate(("a", "b")):
        group(spark, [(ref, "t", None, None, None, "1", None, n)]).coalesce(1).write.parquet(f"{scratch}/in{n}")
        stream_merge(spark, f"{scratch}/in{n}", root, f"{scratch}/ckpt{n}", "q", "p", 25, "2024-02-01 00:00:00")
    assert sorted(r["ref_id"] for r in IO.load_store(spark, root).collect()) == ["a", "b"]


@pytest.mark.parametrize("only_newer", [False, True])
def test_late_rows_and_many_batches_equal_the_batch_merge(spark, scratch, only_newer):
    """Rows out of order inside a file, late stamps across files, a hot ref, a restart between."""
    rnd = random.Random(7)
    landing, root, ckpt = scratch + "/in", scratch + "/store", scratch + "/ckpt"
    store = ST.empty_store(spark)
    for b in range(3):
        rows = [("hot" if rnd.random() < 0.4 else rnd.choice([None, "", "a", "b", "c", "d"]), f"t{b}-{i}", None, None, None,
                 rnd.choice([None, "", "2024-01-01", "2024-01-02", "2024-01-03"]), None, 100 * b + i) for i in range(30)]
        rnd.shuffle(rows)
        as_of = f"2024-03-0{b + 1} 00:00:00"
        group(spark, rows).repartition(2).write.mode("append").parquet(landing)
        stream_merge(spark, landing, root, ckpt, f"q{b % 2}", "p", 25, as_of, only_newer=only_newer)
        store = ST.merge_listings(store, group(spark, rows), f"q{b % 2}", "p", as_of, only_newer=only_newer).store
        store = materialize(store, "expected")
        time.sleep(1.1)
    assert snapshot_rows(IO.load_store(spark, root)) == snapshot_rows(store)


def test_replayed_batch_changes_nothing(spark, scratch):
    """A batch saved but not committed by the stream comes again: skipped by tag, or merged to the same."""
    root = scratch + "/store"
    rows = [("a", "t1", None, None, None, "1", None, 1), ("a", "t2", None, None, None, "2", None, 2),
            ("b", "t3", None, None, None, None, None, 3)]
    group(spark, rows).coalesce(1).write.parquet(scratch + "/in")
    file = spark.read.parquet(scratch + "/in").select("_metadata.file_path").first()[0]
    winners = spark.createDataFrame([("a", 2, file), ("b", 3, file)], "ref_id string, eff_ord long, eff_file string")
    seen = []
    for tag in ("x-0", "x-0", "x-1"):
        save_winners(spark, winners, tag, root, "q", "p", 25, "2024-02-01 00:00:00")
        seen.append((IO.save_number(spark, root), snapshot_rows(IO.load_store(spark, root))))
    assert [n for n, _ in seen] == [1, 1, 2]
    assert seen[0][1] == seen[1][1] == seen[2][1] and len(seen[0][1]) == 2


def test_state_of_an_old_store_is_taken_over(spark, scratch):
    """A new checkpoint knows the stored stamps: the same version again leaves the details alone."""
    root = scratch + "/store"
    details = (True, "x", None, None, None, 1, None, None, None)
    when = datetime.datetime(2024, 1, 1)
    IO.save_store(spark, root, spark.createDataFrame([("a", "old", None, None, None, "1", None, when, when, [], details)], S.STORE),
                  lambda w: ST.store_metadata(w, None, "2024-01-01 00:00:00", "p", 25))
    group(spark, [("a", "again", None, None, None, "1", None, 1)]).write.parquet(scratch + "/in")
    stream_merge(spark, scratch + "/in", root, scratch + "/ckpt", "q", "p", 25, "2024-02-01 00:00:00")
    row = IO.load_store(spark, root).first()
    assert (row["title"], row["details"]["text"], len(row["found_in"])) == ("old", "x", 1)


def test_stream_keeps_no_state_beside_the_store(spark, scratch):
    """Many refs cost no Python call each, and what another job saves in between counts."""
    landing, root, ckpt = scratch + "/in", scratch + "/store", scratch + "/ckpt"
    many = spark.range(20_000).selectExpr(
        "concat('r', id) AS ref_id", "'first' AS title", "CAST(NULL AS string) AS employer", "CAST(NULL AS struct<city: string>) AS location",
        "CAST(NULL AS string) AS external_url", "'1' AS modified_at", "CAST(NULL AS date) AS published_on", "id AS batch_ord")
    many.select(*COLS).write.parquet(landing)
    handle = stream_merge(spark, landing, root, ckpt, "q", "p", 25, "2024-02-01 00:00:00")
    assert handle.lastProgress is None or not handle.lastProgress["stateOperators"]
    assert IO.load_store(spark, root).count() == 20_000
    # another job saves version 2 of one ref: the stream's version 2 is no change
    merged = ST.merge_saved(spark, root, group(spark, [("r5", "other", None, None, None, "2", None, 1)]), "q", "p", "2024-02-02 00:00:00")
    meta = IO.load_metadata(spark, root)
    IO.save_touched(spark, root, merged.store, lambda w: ST.store_metadata(w, meta, "2024-02-02 00:00:00", "p", 25))
    time.sleep(1.1)
    group(spark, [("r5", "stream", None, None, None, "2", None, 2), ("r5", "stream", None, None, None, "2", None, 2),
                  ("r6", "second", None, None, None, "3", None, 3)]).write.mode("append").parquet(landing)
    stream_merge(spark, landing, root, ckpt, "q", "p", 25, "2024-02-03 00:00:00")
    got = {r["ref_id"]: r["title"] for r in IO.load_store(spark, root).where("ref_id IN ('r5', 'r6', 'r7')").collect()}
    assert got == {"r5": "other", "r6": "second", "r7": "first"}
