"""Merge = a plain sequential fold over the batch (repeated refs, null, empty and older
stamps), for small and large ord chunks."""

import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import store as ST

AS_OF = "2024-03-01 00:00:00"
T0 = datetime(2024, 1, 1)


def naive_fold(store, batch, query, place, as_of):
    """Reference semantics written as a loop (the thing the window must equal)."""
    store = {k: dict(v, found=list(v["found"])) for k, v in store.items()}
    statuses = {}
    for row in sorted(batch, key=lambda r: r["batch_ord"]):
        ref = row["ref_id"]
        if not ref:
            continue
        stamp = row["modified_at"]
        if ref not in store:
            store[ref] = {"stamp": stamp, "title": row["title"], "first": as_of, "last": as_of,
                          "found": [(query, place)], "details": False}
            statuses[row["batch_ord"]] = "new"
            continue
        e = store[ref]
        e["last"] = as_of
        if (query, place) not in e["found"]:
            e["found"].append((query, place))
        if stamp and stamp != e["stamp"]:
            e.update(stamp=stamp, title=row["title"], details=False)
            statuses[row["batch_ord"]] = "updated"
        else:
            statuses[row["batch_ord"]] = "unchanged"
    return store, statuses


def random_case(seed):
    rnd = random.Random(seed)
    refs = [f"r{i}" for i in range(7)] + ["", None]
    stamps = [None, "", "2024-01-01", "2024-01-02", "2024-01-03"]
    store = {}
    for r in rnd.sample(refs[:7], 3):
        store[r] = {"stamp": rnd.choice(stamps), "title": "old-" + r, "first": "2023-12-01 00:00:00",
                    "last": "2023-12-01 00:00:00",
                    "found": [rnd.choice([("q", "p"), ("other", "p")])], "details": True}
    batch = [{"ref_id": rnd.choice(refs), "modified_at": rnd.choice(stamps), "title": f"t{i}",
              "batch_ord": i * 3 + rnd.randint(0, 2)} for i in range(40)]
    return store, batch


def to_frames(spark, store, batch):
    srows = []
    for ref, e in store.items():
        details = (True, "x", None, None, None, 1, None, None, None) if e["details"] else None
        srows.append((ref, e["title"], None, None, None, e["stamp"], None,
                      datetime.fromisoformat(e["first"]), datetime.fromisoformat(e["last"]),
                      [(q, p, T0) for q, p in e["found"]], details))
    sdf = spark.createDataFrame(srows, S.STORE)
    brows = [(r["ref_id"], r["title"], None, None, None, r["modified_at"], None, r["batch_ord"])
             for r in batch]
    return sdf, spark.createDataFrame(brows, S.LISTING)


@pytest.mark.parametrize("seed,parts", [(1, 4), (2, 4), (3, 1), (4, 7)])
def test_merge_equals_sequential_fold(spark, seed, parts):
    store, batch = random_case(seed)
    want_store, want_status = naive_fold(store, batch, "q", "p", AS_OF)
    sdf, bdf = to_frames(spark, store, batch)
    res = ST.merge_listings(sdf, bdf, "q", "p", AS_OF, parts=parts)
    got_status = {r["batch_ord"]: r["status"] for r in res.classified.collect()}
    assert got_status == want_status
    got = {r["ref_id"]: r for r in res.store.collect()}
    assert set(got) == set(want_store)
    for ref, e in want_store.items():
        g = got[ref]
        assert g["modified_at"] == e["stamp"], ref
        assert g["title"] == e["title"], ref
        assert g["first_seen"].isoformat(sep=" ") == e["first"], ref
        assert g["last_seen"].isoformat(sep=" ") == e["last"], ref
        assert [(f["query"], f["place"]) for f in g["found_in"]] == e["found"], ref
        assert (g["details"] is not None) == e["details"], ref


def test_delta_summary_counts_distinct_refs(spark):
    store, batch = random_case(5)
    _, statuses = naive_fold(store, batch, "q", "p", AS_OF)
    sdf, bdf = to_frames(spark, store, batch)
    res = ST.merge_listings(sdf, bdf, "q", "p", AS_OF, parts=4)
    row = ST.delta_summary(res.per_ref, res.store).collect()[0]
    by_ord = {r["batch_ord"]: r["ref_id"] for r in batch}
    for st in ("new", "updated", "unchanged"):
        assert row[st] == len({by_ord[o] for o, s in statuses.items() if s == st})


def test_context_guard():
    ST.check_context(None, "Berlin", 25)
    ST.check_context({"place": None, "radius_km": None}, "Hamburg", 10)
    ST.check_context({"place": "Berlin", "radius_km": 25}, "Berlin", 25)
    with pytest.raises(ST.ContextMismatchError):
        ST.check_context({"place": "Berlin", "radius_km": 25}, "Berlin", 50)
    with pytest.raises(ST.ContextMismatchError):
        ST.check_context({"place": None, "radius_km": 25}, "Berlin", 25)


def test_store_roundtrip_and_lookup_pushdown(spark, scratch):
    from listforge.sources import store_io as IO

    store, batch = random_case(6)
    sdf, bdf = to_frames(spark, store, batch)
    res = ST.merge_listings(sdf, bdf, "q", "p", AS_OF)
    root = scratch + "/store"
    assert not IO.store_exists(spark, root) and IO.save_number(spark, root) == 0
    assert IO.load_store(spark, root).count() == 0 and IO.find_listing(spark, root, "r1").count() == 0
    assert IO.save_store(spark, root, res.store, ST.store_metadata(res.store, None, AS_OF, "p", 25)) == 1
    loaded = IO.load_store(spark, root)
    assert loaded.count() == res.store.count() == IO.load_metadata(spark, root)["total"]
    later = "2024-04-01 00:00:00"
    res2 = ST.merge_saved(spark, root, bdf, "q", "p", later)
    meta = IO.load_metadata(spark, root)
    assert IO.save_touched(spark, root, res2.store, lambda w: ST.store_metadata(w, meta, later, "p", 25)) == 2
    assert str(IO.load_metadata(spark, root)["created"]).startswith("2024-03-01")
    found = IO.find_listing(spark, root, "r1")
    assert [r["ref_id"] for r in found.collect()] == ["r1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ref_id,r1)" in plan and re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", plan)


def bucket_files(root):
    out = {}
    for folder, _, names in os.walk(root + "/listings"):
        for n in names:
            if n.endswith(".parquet"):
                at = os.path.join(folder, n)
                out.setdefault(os.path.basename(folder), set()).add((n, os.stat(at).st_mtime_ns))
    return out


def test_a_merge_reads_and_writes_touched_buckets_only(spark, scratch):
    from listforge.sources import store_io as IO

    root = scratch + "/store"
    rows = [{"ref_id": f"r{i}", "modified_at": "1", "title": f"t{i}", "batch_ord": i} for i in range(300)]
    _, first = to_frames(spark, {}, rows)
    res = ST.merge_listings(ST.empty_store(spark), first, "q", "p", AS_OF)
    IO.save_store(spark, root, res.store, lambda w: ST.store_metadata(w, None, AS_OF, "p", 25), buckets=16)
    before = bucket_files(root)
    assert len(before) == 16
    batch = [{"ref_id": "r7", "modified_at": "2", "title": "new7", "batch_ord": 1},
             {"ref_id": "r8", "modified_at": "1", "title": "same8", "batch_ord": 2},
             {"ref_id": "added", "modified_at": "", "title": "n", "batch_ord": 3},
             {"ref_id": None, "modified_at": "9", "title": "no ref", "batch_ord": 4}]
    _, second = to_frames(spark, {}, batch)
    touched = IO.touched_buckets(spark, root, second)
    merged = ST.merge_saved(spark, root, second, "q2", "p", "2024-04-01 00:00:00")
    plan = merged.store._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+", plan)
    want = {r["ref_id"]: r["title"] for r in ST.merge_listings(
        IO.load_store(spark, root), second, "q2", "p", "2024-04-01 00:00:00").store.collect()}
    meta = IO.load_metadata(spark, root)
    IO.save_touched(spark, root, merged.store, lambda w: ST.store_metadata(w, meta, "2024-04-01 00:00:00", "p", 25))
    after = bucket_files(root)
    changed = {b for b in before if before[b] != after[b]}
    assert changed == {f"bucket={b}" for b in touched} and 1 <= len(touched) <= 3
    assert {r["ref_id"]: r["title"] for r in IO.load_store(spark, root).collect()} == want
    assert (want["r7"], want["r8"], len(want), IO.load_metadata(spark, root)["total"]) == ("new7", "t8", 301, 301)


def test_merging_a_batch_again_gives_the_same_store(spark, scratch):
    """What makes a repeated run after a lost driver harmless."""
    from listforge.sources import store_io as IO

    root, seen = scratch + "/store", []
    store, batch = random_case(9)
    sdf, bdf = to_frames(spark, store, batch)
    IO.save_store(spark, root, sdf.drop("details").withColumn("details", F.lit(None).cast(S.DETAILS)),
                  lambda w: ST.store_metadata(w, None, AS_OF, "p", 25), buckets=4)
    for _ in range(2):
        res = ST.merge_saved(spark, root, bdf, "q", "p", AS_OF)
        IO.save_touched(spark, root, res.store, lambda w: ST.store_metadata(w, None, AS_OF, "p", 25))
        seen.append(sorted(map(str, IO.load_store(spark, root).collect())))
    assert seen[0] == seen[1]


def test_replacing_the_store_drops_old_buckets(spark, scratch):
    from listforge.sources import store_io as IO

    root = scratch + "/store"
    _, rows = to_frames(spark, {}, [{"ref_id": f"r{i}", "modified_at": "1", "title": "t", "batch_ord": i} for i in range(20)])
    all_rows = ST.merge_listings(ST.empty_store(spark), rows, "q", "p", AS_OF).store
    meta = lambda w: ST.store_metadata(w, None, AS_OF, "p", 25)
    IO.save_store(spark, root, all_rows, meta, buckets=8)
    IO.save_store(spark, root, IO.load_store(spark, root).where("ref_id = 'r3'"), meta, buckets=99)
    assert [r["ref_id"] for r in IO.load_store(spark, root).collect()] == ["r3"]
    assert IO.load_metadata(spark, root)["buckets"] == 8 and IO.load_metadata(spark, root)["total"] == 1


def test_attach_details_and_history(spark):
    store, batch = random_case(7)
    sdf, bdf = to_frames(spark, store, batch)
    res = ST.merge_listings(sdf, bdf, "q", "p", AS_OF)
    det = spark.createDataFrame([("r0", 1, (True, "t", None, None, None, 1, None, None, None)),
                                 ("zz", 1, (True, "t", None, None, None, 1, None, None, None))],
                                "ref_id string, batch_ord long, details " + S.DETAILS.simpleString())
    out = ST.attach_details(res.store, det)
    assert out.count() == res.store.count()
    assert ST.has_search_history(res.store, "q", "p")
    assert not ST.has_search_history(res.store, "q", "elsewhere")
    assert out.where(F.col("ref_id") == "r0").where(F.col("details.text") == "t").count() == \
        res.store.where(F.col("ref_id") == "r0").count()


def test_only_newer_option_in_batch_merge(spark):
    store = {"a": {"stamp": "2024-01-05", "title": "kept", "first": "2023-12-01 00:00:00",
                   "last": "2023-12-01 00:00:00", "found": [("q", "p")], "details": True}}
    batch = [{"ref_id": "a", "modified_at": "2024-01-01", "title": "late", "batch_ord": 1},
             {"ref_id": "b", "modified_at": "2024-01-01", "title": "new", "batch_ord": 2}]
    sdf, bdf = to_frames(spark, store, batch)
    default = {r["ref_id"]: r["title"] for r in
               ST.merge_listings(sdf, bdf, "q", "p", AS_OF).store.collect()}
    newer = {r["ref_id"]: r["title"] for r in
             ST.merge_listings(sdf, bdf, "q", "p", AS_OF, only_newer=True).store.collect()}
    assert default == {"a": "late", "b": "new"}
    assert newer == {"a": "kept", "b": "new"}


@pytest.mark.parametrize("parts", [1, 5])
def test_page_packed_orders_and_a_hot_ref(spark, parts):
    """Orders numbered page << 32 | position, one ref with most rows: same as the plain fold."""
    rnd = random.Random(11)
    batch = [{"ref_id": "hot" if rnd.random() < 0.8 else f"r{i % 5}", "modified_at": rnd.choice(["", "1", "2", "3"]),
              "title": f"t{i}", "batch_ord": (i // 7 << 32) + i % 7} for i in range(150)]
    want_store, want_status = naive_fold({}, batch, "q", "p", AS_OF)
    _, bdf = to_frames(spark, {}, batch)
    res = ST.merge_listings(ST.empty_store(spark), bdf, "q", "p", AS_OF, parts=parts)
    assert {r["batch_ord"]: r["status"] for r in res.classified.collect()} == want_status
    assert {r["ref_id"]: r["title"] for r in res.store.collect()} == {k: v["title"] for k, v in want_store.items()}


@pytest.mark.parametrize("parts", [1, 4])
def test_only_newer_inside_one_batch(spark, parts):
    """An older row later in the batch never wins; it still counts as seen."""
    store = {"a": {"stamp": "2024-01-05", "title": "old", "first": AS_OF, "last": "2023-12-01 00:00:00",
                   "found": [("other", "p")], "details": False}}
    batch = [{"ref_id": r, "modified_at": m, "title": t, "batch_ord": i} for i, (r, m, t) in enumerate([
        ("a", "2024-01-09", "newest"), ("a", "2024-01-07", "late"), ("a", "", "blank"),
        ("b", "2024-01-02", "b2"), ("b", "2024-01-01", "b1"), ("b", "2024-01-02", "same")])]
    sdf, bdf = to_frames(spark, store, batch)
    res = ST.merge_listings(sdf, bdf, "q", "p", AS_OF, parts=parts, only_newer=True)
    assert {r["batch_ord"]: r["status"] for r in res.classified.collect()} == {
        0: "updated", 1: "unchanged", 2: "unchanged", 3: "new", 4: "unchanged", 5: "unchanged"}
    got = {r["ref_id"]: r for r in res.store.collect()}
    assert (got["a"]["title"], got["b"]["title"]) == ("newest", "b2")
    assert len(got["a"]["found_in"]) == 2 and got["a"]["last_seen"].isoformat(sep=" ") == AS_OF


def test_details_of_the_last_row_win(spark):
    store = ST.empty_store(spark)
    sdf, bdf = to_frames(spark, {}, [{"ref_id": "a", "modified_at": "1", "title": "t", "batch_ord": 1}])
    store = ST.merge_listings(store, bdf, "q", "p", AS_OF).store
    rows = [("a", o, (True, f"text{o}", None, None, None, 1, None, None, None)) for o in (3, 9, 5)] + [("x", 1, None)]
    det = spark.createDataFrame(rows, "ref_id string, batch_ord long, details " + S.DETAILS.simpleString())
    assert [r["details"]["text"] for r in ST.attach_details(store, det).collect()] == ["text9"]
    assert ST.attach_details(store, det.drop("batch_ord").where("ref_id = 'a'")).count() == 1
