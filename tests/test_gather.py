"""Gather (J11/E14): first run, repeat run (incremental window, nothing to do),
nothing found (store untouched, K19), context guard."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from listforge.operators import store as ST
from listforge.plans import gather as G
from listforge.sources import store_io as IO

AS_OF = "2024-03-10 00:00:00"
LONG = "word " * 300


def land(spark, path, pages):
    lines = [json.dumps(p) for p in pages]
    spark.createDataFrame([(x,) for x in lines], "value string").write.mode("overwrite").text(path)


def listing(ref, url, day, title="Data Engineer", stamp="s1"):
    return {"ref_id": ref, "title": title, "employer": "E", "location": {"city": "Berlin"},
            "external_url": url, "modified_at": stamp, "published_on": day}


@pytest.fixture()
def corpus(spark):
    rows = [("https://a.example.org/1", f"<html><body><main>{LONG}</main></body></html>"),
            ("https://b.example.org/2", "<html><body><p>short</p></body></html>")]
    return spark.createDataFrame(rows, "url string, html string")


def test_gather_cycle(spark, scratch, corpus):
    landing, root = scratch + "/landing", scratch + "/store"
    recent = "2024-03-08"
    land(spark, landing, [
        {"page": 1, "status": 200, "total": "3", "listings": [
            listing("r1", "https://a.example.org/1", recent),
            listing("r2", "https://b.example.org/2", recent),
            listing("r3", None, "2024-01-01", title="Ausbildung Koch")]},
        {"page": 2, "status": 200, "total": "3", "listings": [
            listing("r4", None, recent)]}])
    g1 = G.gather(spark, landing, root, corpus, "data", "Berlin", 25, AS_OF,
                  "https://jobs.example.org/detail")
    s1 = g1.summary.collect()[0]
    assert (s1["total_found"], s1["new"], s1["extracted"], s1["failed"]) == (3, 3, 1, 2)
    assert g1.window_days is None
    store = IO.load_store(spark, root)
    assert store.count() == 3
    assert store.where(F.col("details").isNotNull()).count() == 3
    first = IO.save_number(spark, root)

    # the same search again: history -> 7-day window; nothing changed -> saved anyway
    g2 = G.gather(spark, landing, root, corpus, "data", "Berlin", 25, "2024-03-11 00:00:00",
                  "https://jobs.example.org/detail")
    s2 = g2.summary.collect()[0]
    assert g2.window_days == 7
    assert (s2["total_found"], s2["total_scraped"], s2["unchanged"]) == (3, 0, 3)
    assert IO.save_number(spark, root) != first
    last_seen = {r["ref_id"]: r["last_seen"] for r in IO.load_store(spark, root).collect()}
    assert last_seen["r1"] == dt.datetime(2024, 3, 11)
    assert IO.load_store(spark, root).where(F.col("details").isNotNull()).count() == 3

    # nothing landed for a repeat search: store untouched, totals reported
    empty = scratch + "/empty"
    land(spark, empty, [{"page": 1, "status": 200, "total": "0", "listings": []}])
    before = IO.save_number(spark, root)
    g3 = G.gather(spark, empty, root, corpus, "data", "Berlin", 25, AS_OF,
                  "https://jobs.example.org/detail")
    s3 = g3.summary.collect()[0]
    assert (s3["total_found"], s3["new"], s3["database_total"]) == (0, 0, 3)
    assert IO.save_number(spark, root) == before

    # another place: refused
    with pytest.raises(ST.ContextMismatchError):
        G.gather(spark, landing, root, corpus, "data", "Hamburg", 25, AS_OF,
                 "https://jobs.example.org/detail")


def test_nothing_found_leaves_store(spark, scratch, corpus):
    landing, root = scratch + "/landing", scratch + "/store"
    land(spark, landing, [{"page": 1, "status": 200, "total": "0", "listings": []}])
    g = G.gather(spark, landing, root, corpus, "data", "Berlin", 25, AS_OF,
                 "https://jobs.example.org/detail")
    assert g.summary.collect()[0]["total_found"] == 0
    assert not IO.store_exists(spark, root)
