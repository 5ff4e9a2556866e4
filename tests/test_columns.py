"""JVM column expressions agree with the same rules in plain Python."""

import random

import plain
from pyspark.sql import functions as F

from listforge.functions import columns as C
from listforge.operators import stats as ST

ALPHABET = list("ab cJavaScript") + ["\t", "\n", "\r", "\x0b", "\x0c", "\xa0", " ", "　",
                                       " ", "\x1c", "\x85", "​", "é", "-", "_"]


def strings(seed, n=400, max_len=40):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len))),) for _ in range(n)]


def test_clean_text_and_js_rule_match_python(spark):
    rows = strings(1) + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", C.clean_text("t").alias("c")).collect()
    for r in got:
        assert r["c"] == plain.clean_text(r["t"]), repr(r["t"])
    cleaned = [(plain.clean_text(t) + " javascript" * (i % 2),) for i, (t,) in enumerate(rows)]
    df2 = spark.createDataFrame(cleaned + [("x" * 499 + "javascript",), ("x" * 490 + "JavaScript",)],
                                "t string")
    for r in df2.select("t", C.needs_javascript("t").alias("js")).collect():
        assert r["js"] == plain.needs_javascript(r["t"]), repr(r["t"])


def test_url_domain_matches_python(spark):
    rnd = random.Random(2)
    parts = ["http", "https", "HTTPS", "ftp", "mailto", "x+y.z-1", "1abc"]
    hosts = ["a.example.org", "user:pw@h:8080", "[::1]:80", "", "h"]
    tails = ["", "/", "/p?q=1", "?q", "#f", "/a/b#c"]
    urls = []
    for _ in range(300):
        scheme = rnd.choice(parts)
        sep = rnd.choice(["://", ":", "//", ""])
        urls.append(f"{scheme}{sep}{rnd.choice(hosts)}{rnd.choice(tails)}")
    urls += ["//host/x", "www.example.org/a", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", C.url_domain("url").alias("d")).collect():
        assert r["d"] == plain.url_domain(r["url"]), r["url"]


def test_percentages_guard_zero_total(spark):
    counts = spark.createDataFrame([("Good Match", 3, 0)], "category string, n long, first_ord long")
    assert ST.category_percentages(counts, 0).collect()[0]["pct"] == 0.0
    assert ST.category_percentages(counts, 4).collect()[0]["pct"] == 75.0


def test_error_type_and_slug(spark):
    warnings = [None, "JS_REQUIRED", "SHORT_CONTENT", "NO_CONTENT", "TIMEOUT", "EXCEPTION",
                "LOW_QUALITY", "EXCESSIVE_CONTENT", "UNKNOWN"]
    df = spark.createDataFrame([(w,) for w in warnings], "w string")
    got = [r[0] for r in df.select(C.error_type("w")).collect()]
    assert got == ["ERROR", "JS_REQUIRED", "SHORT_CONTENT", "NO_CONTENT", "TIMEOUT", "EXCEPTION",
                   "ERROR", "ERROR", "ERROR"]
    s = spark.createDataFrame([("Excellent Match",), ("JS_REQUIRED",), ("a-b c_d",)], "x string")
    assert [r[0] for r in s.select(C.slug("x")).collect()] == ["excellentmatch", "jsrequired", "abcd"]
    ids = spark.createDataFrame([("20240102_030405",), ("2024-01-02",), (None,)], "r string")
    out = ids.select(C.run_id_valid("r").alias("v"),
                     F.date_format(C.run_id_timestamp("r"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert [(r["v"], r["t"]) for r in out] == [(True, "2024-01-02 03:04:05"), (False, None),
                                               (False, None)]
