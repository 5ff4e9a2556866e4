"""Domain statistics: primary warning/method ties go to the first seen value; one scan."""

import random

from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import stats as ST
from listforge.plans import bindings as B

SF = "/root/testdata/sf0.001"


def python_domain_stats(rows):
    """The dict-insertion-order semantics the primaries must reproduce."""
    out = {}
    for ord_, src, ok, domain, method, warning, length in sorted(rows):
        if src != "external":
            continue
        d = out.setdefault(domain or "unknown", {"n": 0, "ok": 0, "warn": {}, "meth": {}, "len": []})
        d["n"] += 1
        d["ok"] += int(bool(ok))
        d["len"].append(length or 0)
        if warning:
            d["warn"][warning] = d["warn"].get(warning, 0) + 1
        m = method if method is not None else "unknown"
        d["meth"][m] = d["meth"].get(m, 0) + 1
    res = {}
    for dom, d in out.items():
        res[dom] = (d["n"], d["ok"], sum(d["len"]) // d["n"], min(d["len"]), max(d["len"]),
                    max(d["warn"].items(), key=lambda x: x[1])[0] if d["warn"] else None,
                    max(d["meth"].items(), key=lambda x: x[1])[0] if d["meth"] else None)
    return res


def test_domain_stats_match_dict_order(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        rows.append((i, rnd.choice(["external", "external", "internal"]), rnd.random() < 0.5,
                     rnd.choice(["a.org", "b.org", "c.org", None]),
                     rnd.choice(["css_selector", "fallback", "json_ld", None]),
                     rnd.choice([None, "", "SHORT_CONTENT", "JS_REQUIRED", "LOW_QUALITY"]),
                     rnd.choice([None, 10, 500, 2000])))
    df = spark.createDataFrame(
        [(o, (ok, None, None, src, m, ln, dom, w, None)) for o, src, ok, dom, m, w, ln in rows],
        "ord long, details " + S.DETAILS.simpleString())
    got = {r["domain"]: (r["total"], r["successful"], r["avg_text_length"], r["min_text_length"],
                         r["max_text_length"], r["primary_warning"], r["primary_method"])
           for r in ST.stats_by_domain(df).collect()}
    assert got == python_domain_stats(rows)


def test_domain_stats_scan_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "doc_id AS ord",
        "named_struct('success', n_chars >= 1000, 'text', text, 'url', CAST(NULL AS STRING), "
        "'source', 'external', 'method', 'css_selector', 'text_length', n_chars, "
        "'domain', source, 'warning', CAST(NULL AS STRING), 'error', CAST(NULL AS STRING)) AS details")
    plan = ST.stats_by_domain(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_extraction_report_scans_twice(spark):
    from listforge.plans import bindings as B

    docs = B.doc_listings(spark, "/root/testdata/sf0.001")
    plan = ST.extraction_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2


def test_partials_give_the_same_statistics(spark):
    docs = B.doc_listings(spark, SF)
    halves = ST.stat_partials(docs.where("ord % 2 = 0")).unionByName(ST.stat_partials(docs.where("ord % 2 = 1")))
    partials = ST.stat_partials(halves)
    for fn in (ST.stats_by_source, ST.stats_by_domain, ST.stats_by_method, ST.stats_by_warning, ST.failures_by_warning,
               ST.failures_by_domain_top, ST.good_domains, ST.problem_domains, ST.extraction_report):
        assert sorted(map(str, fn(partials).collect())) == sorted(map(str, fn(docs).collect())), fn.__name__


def test_stored_statistics_follow_two_merges_by_touched_buckets(spark, scratch):
    """Equal to counting all listings again; only the touched buckets are read and rewritten."""
    import os
    import re

    from test_plans import formatted

    from listforge.operators import store as STORE
    from listforge.operators import store_stats as SS
    from listforge.sources import store_io as IO

    root = scratch + "/store"

    def details(ok, i):
        return (ok, "x" * i, None, "external", "css", i, f"d{i % 3}", None if ok else "SHORT_CONTENT", None)

    def merge(refs, stamp, as_of):
        rows = spark.createDataFrame([(r, "t", None, None, None, stamp, None, i) for i, r in enumerate(refs)], S.LISTING)
        touched = IO.touched_buckets(spark, root, rows) if IO.store_exists(spark, root) else None
        res = STORE.merge_saved(spark, root, rows, "q", "p", as_of)
        det = spark.createDataFrame([(r, i, details(i % 2 == 0, i)) for i, r in enumerate(refs)],
                                    "ref_id string, batch_ord long, details " + S.DETAILS.simpleString())
        IO.save_touched(spark, root, STORE.attach_details(res.store, det), lambda w: STORE.store_metadata(w, None, as_of, "p", 25))
        SS.refresh_stats(spark, root, touched)
        return touched

    merge([f"r{i}" for i in range(60)], "1", "2024-01-01 00:00:00")
    before = {b: os.listdir(f"{root}/stats/{b}") for b in os.listdir(root + "/stats") if b.startswith("bucket")}
    touched = merge(["r3", "r4", "new"], "2", "2024-01-02 00:00:00")
    after = {b: os.listdir(f"{root}/stats/{b}") for b in os.listdir(root + "/stats") if b.startswith("bucket")}
    assert {b for b in after if after[b] != before.get(b)} == {f"bucket={b}" for b in touched}
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (IN|INSET|=)", formatted(SS.bucket_partials(spark, root, touched)))
    everything = IO.load_store(spark, root).select("details", F.unix_micros("first_seen").alias("ord")).where("details is not null")
    stored = SS.store_partials(spark, root)
    for fn in (ST.stats_by_source, ST.stats_by_method, ST.stats_by_warning, ST.failures_by_warning):
        assert sorted(map(str, fn(stored).collect())) == sorted(map(str, fn(everything).collect())), fn.__name__
    cols = ["domain", "total", "successful", "avg_text_length", "min_text_length", "max_text_length"]
    assert sorted(map(tuple, ST.stats_by_domain(stored).select(cols).collect())) == sorted(
        map(tuple, ST.stats_by_domain(everything).select(cols).collect()))
