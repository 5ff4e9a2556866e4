"""Paging rules of landed search responses, and the chunked running sum."""

import json
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators.indexing import running_sum
from listforge.sources import search_pages as SP
from test_plans import formatted


def pages_df(spark, pages):
    rows = []
    for page, status, total, titles in pages:
        listings = [(f"{page}-{i}", t, None, None, None, None, None) for i, t in enumerate(titles)]
        rows.append((page, status, total, listings))
    return spark.createDataFrame(rows, S.SEARCH_PAGE)


def kept_refs(spark, pages, max_pages, keywords=("ausbildung",)):
    out = SP.page_prefix(pages_df(spark, pages), max_pages, list(keywords))
    return sorted(r["ref_id"] for r in out.collect())


@pytest.mark.parametrize("pages,max_pages,want", [
    # total reached on page 2 (after filtering): page 3 never read
    ([(1, 200, "4", ["a", "b"]), (2, 200, "4", ["c", "d"]), (3, 200, "4", ["e"])], 9,
     ["1-0", "1-1", "2-0", "2-1"]),
    # exclusions mean the unfiltered total is never reached: all pages read
    ([(1, 200, "3", ["a", "Ausbildung x"]), (2, 200, "3", ["c"]), (3, 200, "3", ["e"])], 9,
     ["1-0", "2-0", "3-0"]),
    # a failed page stops reading before it
    ([(1, 200, "99", ["a"]), (2, 500, "99", ["b"]), (3, 200, "99", ["c"])], 9, ["1-0"]),
    # an empty page stops reading before it
    ([(1, 200, "99", ["a"]), (2, 200, "99", []), (3, 200, "99", ["c"])], 9, ["1-0"]),
    # a missing page stops reading before it
    ([(1, 200, "99", ["a"]), (3, 200, "99", ["c"])], 9, ["1-0"]),
    ([(2, 200, "99", ["a"])], 9, []),
    # max pages
    ([(1, 200, "99", ["a"]), (2, 200, "99", ["b"]), (3, 200, "99", ["c"])], 2, ["1-0", "2-0"]),
    # missing total counts as 0: reading stops after page 1
    ([(1, 200, None, ["a"]), (2, 200, None, ["b"])], 9, ["1-0"]),
    # all rows excluded on page 1, total reached never
    ([(1, 200, "1", ["Ausbildung"]), (2, 200, "1", ["b"])], 9, ["2-0"]),
])
def test_paging_rules(spark, pages, max_pages, want):
    assert kept_refs(spark, pages, max_pages) == want


def test_running_sum_matches_window(spark):
    df = spark.range(0, 500).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("o"), ((F.col("id") * 7) % 11).alias("v"))
    got = running_sum(df, ["k"], "o", "v", chunk_size=16)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("running", F.sum("v").over(w))
    assert sorted(map(tuple, got.select("k", "o", "running").collect())) == \
        sorted(map(tuple, want.select("k", "o", "running").collect()))


def test_a_broken_line_is_reported_and_stops_paging(spark, scratch):
    good = [json.dumps({"page": p, "status": 200, "total": "9", "listings": [{"ref_id": f"r{p}", "title": "t"}]})
            for p in (1, 2, 3, 4)]
    odd = json.dumps({"page": 5, "status": 200, "total": "9", "listings": [{"ref_id": "r5", "published_on": "never"}]})
    lines = [good[0], "", good[1], good[2][:-9], good[3], odd, "}} no page"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(scratch + "/in")
    bad = {r["page"]: (r["length"], r["head"]) for r in SP.bad_pages(spark, scratch + "/in").collect()}
    assert bad == {3: (len(good[2]) - 9, good[2][:-9]), None: (10, "}} no page")}
    pages = SP.read_search_pages(spark, scratch + "/in")
    assert sorted((r["page"], r["status"], r["listings"] is None) for r in pages.collect()) == [
        (1, 200, False), (2, 200, False), (3, SP.BAD_STATUS, True), (4, 200, False), (5, 200, False)]
    assert sorted(r["ref_id"] for r in SP.page_prefix(pages, None, []).collect()) == ["r1", "r2"]
    spark.createDataFrame([], "value string").write.text(scratch + "/none")
    assert SP.bad_pages(spark, scratch + "/none").count() == SP.read_search_pages(spark, scratch + "/none").count() == 0


def test_landed_listings_are_pruned_by_date(spark, scratch):
    from listforge.plans import gather as G

    def land(landing, days):
        page = {"page": 1, "status": 200, "total": "99", "listings": [
            {"ref_id": f"{landing}{i}", "title": "t", "published_on": d} for i, d in enumerate(days)]}
        spark.createDataFrame([(json.dumps(page),)], "value string").write.mode("overwrite").text(f"{scratch}/{landing}")
        SP.land_search_pages(spark, f"{scratch}/{landing}", scratch + "/landed", landing)

    land("a", ["2024-03-01", "2024-03-08", None, "2024-01-01"])
    land("b", ["2024-03-09"])
    land("a", ["2024-03-01", "2024-03-08", None, "2024-01-01"])  # again: replaced, not doubled
    refs = lambda landing, days: sorted(r["ref_id"] for r in G.recent_listings(
        spark, scratch + "/landed", landing, "2024-03-10 00:00:00", days).collect())
    assert (refs("a", None), refs("a", 7), refs("a", 9), refs("b", 7)) == (["a0", "a1", "a2", "a3"], ["a1"], ["a0", "a1"], ["b0"])
    df = G.recent_listings(spark, scratch + "/landed", "a", "2024-03-10 00:00:00", 7)
    plan = formatted(df)
    assert re.search(r"PartitionFilters: \[[^]]*published_part#\d+ >= 2024-03-03", plan)
    assert re.search(r"PartitionFilters: \[[^]]*landing#\d+ = a", plan)


def test_month_folders_keep_the_same_rows(spark, scratch):
    from listforge.operators import filters as FL

    df = spark.sql("select id, date_add(date'2024-01-01', cast(id as int)) d from range(90)")
    SP.write_by_date(df, scratch + "/m", "d", "MONTH")
    stored = spark.read.parquet(scratch + "/m")
    got = FL.published_within(stored, "2024-03-20", 30, "d", SP.PART, "MONTH")
    assert sorted(r["id"] for r in got.collect()) == sorted(
        r["id"] for r in FL.published_within(df, "2024-03-20", 30, "d").collect())
    assert re.search(r"PartitionFilters: \[[^]]*published_part#\d+ >= 2024-02-01", formatted(got))


def test_each_search_stops_by_its_own_pages(spark):
    rows = [("a", 1, "2", ["x", "y"]), ("a", 2, "2", ["z"]), ("b", 1, "9", ["x"]), ("b", 2, "9", ["Ausbildung", "y"]),
            ("b", 4, "9", ["w"]), ("c", 2, "9", ["x"]), ("d", 1, None, ["x"]), ("d", 2, None, ["y"])]
    pages = spark.createDataFrame(
        [(s, p, 200, t, [(f"{s}{p}-{i}", n, None, None, None, None, None) for i, n in enumerate(names)])
         for s, p, t, names in rows], S.SEARCH_PAGE.simpleString().replace("struct<", "struct<search:string,", 1))
    got = SP.page_prefix(pages, None, ["ausbildung"], search_col="search")
    assert sorted(r["ref_id"] for r in got.collect()) == ["a1-0", "a1-1", "b1-0", "b2-1", "d1-0"]
