"""Extraction cascade: every tier, every warning, the length borders and tree quirks."""

import json
import time

import plain
import pytest
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.functions import page_text as P
from listforge.operators import extract as X


def extract(spark, html, url="u", options=P.DEFAULT_OPTIONS, route=S.SOURCE_EXTERNAL):
    df = spark.createDataFrame([(1, url, html, route)], "page_id long, url string, html string, route string")
    return X.extract_corpus(df, options).select("details.*").first().asDict()


LONG = "word " * 300  # 1500 characters


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def exact(n):
    """A text of exactly n characters after cleaning."""
    return ("abcdefghi " * (n // 10 + 1))[:n].strip().ljust(n, "x")


def ld(obj):
    return f'<script type="application/ld+json">{json.dumps(obj)}</script>'


CASES = {
    "json_ld": (page("<main>short</main>", ld({"@type": "JobPosting", "description": LONG})),
                True, S.METHOD_JSON_LD, None),
    "json_ld_list": (page("<p>x</p>", ld([{"@type": "Other"},
                                          {"@type": "JobPosting", "description": LONG}])),
                     True, S.METHOD_JSON_LD, None),
    "broken_ld_first": (page("<main>" + LONG + "</main>", '<script type="application/ld+json">{bad'
                             "</script>" + ld({"@type": "JobPosting", "description": "y" * 2000})),
                        True, S.METHOD_CSS, None),
    "main_1000": (page("<nav>menu</nav><main>" + exact(1000) + "</main>"), True, S.METHOD_CSS, None),
    "main_999": (page("<main>" + exact(999) + "</main>"), False, S.METHOD_FALLBACK,
                 S.WARN_SHORT_CONTENT),
    "js_main": (page("<main>Please enable JavaScript.</main><div>" + LONG + "</div>"), False,
                S.METHOD_CSS, S.WARN_JS_REQUIRED),
    "js_499": (page("<main>javascript " + exact(488) + "</main>"), False, S.METHOD_CSS,
               S.WARN_JS_REQUIRED),
    "js_500": (page("<main>javascript " + exact(489) + "</main>"), False, S.METHOD_FALLBACK,
               S.WARN_SHORT_CONTENT),
    "heavy_div": (page('<div class="x">' + LONG + '</div><div class="y">small</div>'), True,
                  S.METHOD_HEAVY_DIV, None),
    "paragraphs_nested": (page("<p>" + exact(450) + "<p>" + exact(420) + "</body>"), True,
                          S.METHOD_PARAGRAPHS, None),
    "low_quality": (page(LONG), False, S.METHOD_FALLBACK, S.WARN_LOW_QUALITY),
    "body_class_removed": (page("<p>" + LONG + "</p>").replace("<body>", '<body class="unnavigable">'),
                           False, S.METHOD_FALLBACK, S.WARN_SHORT_CONTENT),
    "null_html": (None, False, None, S.WARN_EXCEPTION),
}


def test_cascade(spark):
    rows = [(i, f"https://user@h{i}.example.org:8080/x?y#z", CASES[n][0]) for i, n in enumerate(sorted(CASES))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in X.extract_corpus(df).select("page_id", "details.*").collect()}
    for i, n in enumerate(sorted(CASES)):
        _, success, method, warning = CASES[n]
        assert (got[i]["success"], got[i]["method"], got[i]["warning"]) == (success, method, warning), n
        assert got[i]["domain"] == f"user@h{i}.example.org:8080"
        assert got[i]["text_length"] == len(got[i]["text"] or ""), n
    null = got[sorted(CASES).index("null_html")]
    assert null["text"] is None and null["error"] == P.NO_PAGE


def test_lenient_json_ld_skips_broken_block(spark):
    html = CASES["broken_ld_first"][0]
    d = extract(spark, html, options=P.ExtractOptions(lenient_json_ld=True))
    assert d["method"] == S.METHOD_JSON_LD and d["text_length"] == 2000


def test_paragraph_tier_counts_nested_text_twice(spark):
    html = CASES["paragraphs_nested"][0]
    d = extract(spark, html)
    assert d["text_length"] == 450 + 1 + 420 + 1 + 420


def test_inline_tags_nbsp_comments_entities(spark):
    html = page("<main>a<b>b</b> c <!-- hidden --> d&amp;e " + exact(1000) + "</main>")
    d = extract(spark, html)
    assert d["text"].startswith("a b c d&e ")
    assert "hidden" not in d["text"]


def test_fallback_error_text(spark):
    d = extract(spark, CASES["main_999"][0])
    assert d["error"] == "Insufficient content (999 chars)"


def test_internal_pages(spark):
    sel = S.INTERNAL_CONTENT_SELECTOR
    ok = extract(spark, f"<html><body><header>h</header><{sel}>short text</{sel}></body></html>", route=S.SOURCE_INTERNAL)
    assert ok["success"] and ok["text"] == "short text" and ok["method"] == S.METHOD_CSS
    missing = extract(spark, "<html><body><p>x</p></body></html>", route=S.SOURCE_INTERNAL)
    assert not missing["success"] and missing["warning"] == S.WARN_NO_CONTENT
    empty = extract(spark, None, route=S.SOURCE_INTERNAL)
    assert empty["warning"] == S.WARN_EXCEPTION and empty["text"] == ""


def test_http_failure_and_routes(spark):
    rows = [(1, "https://a.example.org/1", None, "external", 404),
            (2, "https://jobs.example.org/detail/7", "<p>x</p>", "internal", 200),
            (3, None, None, "none", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, route string, "
                                     "http_status int")
    got = {r["page_id"]: r for r in X.extract_corpus(df).select("page_id", "details.*").collect()}
    assert got[1]["error"] == "HTTP 404" and got[1]["warning"] is None
    assert got[2]["warning"] == S.WARN_NO_CONTENT
    assert got[3]["source"] == S.SOURCE_NONE and not got[3]["success"]


def test_url_domain_expression_matches_python(spark):
    from pyspark.sql import functions as F

    from listforge.functions import columns as C

    urls = ["https://a.b/c", "http://u:p@h:81/x", "//host/y", "www.x.org/a", "mailto:x@y",
            "HTTPS://UP.example/?q", "ftp://h#f", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(C.url_domain("url")).collect()]
    assert got == [plain.url_domain(u) for u in urls]


def test_clean_text_expression_matches_python(spark):
    from listforge.functions import columns as C

    texts = ["  a \t b\n\nc  ", "x  y　", "", None, " z\x1c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.clean_text("t")).collect()]
    assert got == [plain.clean_text(t) for t in texts]


def test_extract_listings_routes_and_failures(spark):
    from listforge import schemas as S2

    base = "https://jobs.example.org/detail"
    sel = S2.INTERNAL_CONTENT_SELECTOR
    pages = spark.createDataFrame([
        ("https://a.example.org/ok", f"<html><body><main>{LONG}</main></body></html>", 200),
        ("https://a.example.org/gone", None, 404),
        (f"{base}/r2", f"<html><body><{sel}>inner text</{sel}></body></html>", 200),
    ], "url string, html string, http_status int")
    listings = spark.createDataFrame([
        ("r1", "t1", None, None, "https://a.example.org/ok", None, None, 1),
        ("r2", "t2", None, None, "   ", None, None, 2),            # blank URL -> internal
        ("r3", "t3", None, None, "https://a.example.org/gone", None, None, 3),
        ("r4", "t4", None, None, "https://a.example.org/never", None, None, 4),
        (None, "t5", None, None, None, None, None, 5),               # no address at all
        ("r1", "t1b", None, None, "https://a.example.org/ok", None, None, 6),  # same page twice
    ], S2.LISTING)
    out = {r["batch_ord"]: r["details"] for r in X.extract_listings(listings, pages, base).collect()}
    assert out[1]["success"] and out[1]["method"] == S2.METHOD_CSS
    assert out[6] == out[1]
    assert out[2]["success"] and out[2]["source"] == S2.SOURCE_INTERNAL and out[2]["text"] == "inner text"
    assert out[3]["error"] == "HTTP 404" and out[3]["warning"] is None
    assert out[4]["warning"] == S2.WARN_EXCEPTION
    assert out[5]["source"] == S2.SOURCE_NONE and out[5]["warning"] is None

    detailed = X.extract_listings(listings, pages, base)
    ok, failed = X.split_outcomes(detailed, base)
    assert sorted(r["ref_id"] for r in ok.collect()) == ["r1", "r1", "r2"]
    f = {r["batch_ord"]: r for r in failed.collect()}
    assert f[3]["url"] == "https://a.example.org/gone" and f[3]["error_type"] == "ERROR"
    assert f[4]["error_type"] == "EXCEPTION"
    assert f[5]["url"] == "" and f[5]["error_type"] == "ERROR" and f[5]["title"] == "t5"


def test_json_ld_description_that_is_no_string(spark):
    long_list = ["x"] * 1500
    d = extract(spark, page(f"<main>{LONG}</main>", ld({"@type": "JobPosting", "description": long_list})))
    assert d["method"] == S.METHOD_CSS  # ends the tier, not the page
    d = extract(spark, page(f"<main>{LONG}</main>", ld({"@type": "JobPosting", "description": 7})))
    assert d["warning"] == S.WARN_EXCEPTION
    two = ld([{"@type": "JobPosting", "description": ["x"]}, {"@type": "JobPosting", "description": LONG}])
    assert extract(spark, page("", two))["method"] == S.METHOD_JSON_LD


def test_template_and_ruby_text_is_no_page_text(spark):
    d = extract(spark, page("<main>a<template>hid<b>den</b></template><ruby>b<rp>(</rp><rt>c</rt></ruby> "
                                + exact(1000) + "</main>"))
    assert d["text"].startswith("a b abcdefghi")


def test_deep_pages_take_linear_time(spark):
    html = page("<div>" * 20_000 + "x " * 2000 + "</div>" * 20_000)
    t = time.perf_counter()
    parts = P.page_parts(html, False)
    assert time.perf_counter() - t < 5
    assert [x.split() for x in parts["strings"]] == [["x"] * 2000] and parts["heavy"] == {"first": 0, "n": 1}
    assert extract(spark, html)["method"] == S.METHOD_HEAVY_DIV


@pytest.mark.parametrize("unit", ["<a ", "<div></p>", "</p>", "x <y ", "<!--", "<p>a</i>", "&#1"])
def test_unended_and_stray_tags_take_linear_time(unit):
    def seconds(size):
        source, best = page("<div>" * 3000) + unit * (size // len(unit)), 9.0
        for _ in range(2):
            t = time.process_time()
            P.page_parts(source, False)
            best = min(best, time.process_time() - t)
        return best

    assert seconds(400_000) < 8 * seconds(100_000) + 0.2


def test_tags_that_never_end_are_text():
    for tail in ("x <y &amp; <b", "<p", "</p <!-- x", "<!x"):
        parts = P.page_parts("<body><p>one</p>" + tail, False)
        assert " ".join(parts["strings"][1:]) == tail.replace("&amp;", "&")
    assert P.page_parts("<body>a&#" + "1" * 6000 + ";b", False)["strings"] == ["a\ufffdb"]


def test_a_tier_alone_survives_a_broken_other(spark):
    broken = page(f"<main>{LONG}</main><div>{LONG}</div><p>{LONG}</p>", ld({"@type": "JobPosting", "description": 7}))
    df = spark.createDataFrame([(1, "u", broken), (2, "u", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["main_text"] for r in X.main_content(df).collect()} == {1: LONG.strip(), 2: ""}
    assert {r["page_id"]: r["body_text"] for r in X.fallback_outcome(df).collect()}[2] == ""
    for tier, empty in (("json_ld", None), ("heavy_div", None), ("paragraphs", "")):
        got = {r["page_id"]: r["tier_text"] for r in X.tier_text(df, tier).collect()}
        assert got == {1: None if tier == "json_ld" else LONG.strip(), 2: empty}


def test_keys_of_any_name_come_back(spark):
    df = spark.createDataFrame([(1, 2, "u", f"<main>{LONG}</main>")], "k long, tier long, url string, html string")
    got = X.extract_corpus(df, key_cols=("k", "tier")).first()
    assert (got["k"], got["tier"], got["url"], got["details"]["success"]) == (1, 2, "u", True)


def test_parse_holds_a_bounded_slice_of_a_batch(spark):
    """A batch is cut by the bytes of its pages, nothing lost: memory does not follow the batch's rows."""
    import pyarrow as pa

    texts = ["x" * 300_000, None, "ü" * 400_000, "", "y" * 3_000_000, "z", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "html"])
    parts = list(X._slices(batch, 1))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3, 4], [5, 6]]
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert list(X._slices(batch.slice(0, 0), 1)) == []
    page = "<body><p>" + "word " * 30_000 + "</p></body>"
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                           F.when(F.col("id") % 7 != 0, F.lit(page)).alias("html"))
    out = {r["page_id"]: r["tier_length"] for r in X.tier_text(rows, "paragraphs").collect()}
    assert out == {i: 149_999 if i % 7 else 0 for i in range(40)}
