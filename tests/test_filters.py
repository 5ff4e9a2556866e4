"""Filter and statistics edge cases the oracle bindings do not reach."""

from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import filters as FL
from listforge.operators import stats as ST
from listforge.operators import store as STO


def test_text_search_and_category_filter(spark):
    df = spark.createDataFrame([("r1", "Data Engineer", "Good Match"), ("r2", None, "Poor Match")],
                               "ref_id string, title string, display_category string")
    assert FL.text_search(df, "   ", ["ref_id", "title"]).count() == 2
    assert FL.text_search(df, None, ["ref_id", "title"]).count() == 2
    assert [r[0] for r in FL.text_search(df, " ENGINEER ", ["title"]).collect()] == ["r1"]
    assert FL.category_filter(df, "all").count() == 2
    assert FL.category_filter(df, "Poor Match").count() == 1


def test_exclude_keywords_keeps_missing_titles(spark):
    df = spark.createDataFrame([("Ausbildung Koch",), ("Weiterbildung",), ("Koch",), (None,)],
                               "title string")
    assert sorted(r[0] or "" for r in FL.exclude_keywords(df).collect()) == ["", "Koch"]
    assert FL.exclude_keywords(df, []).count() == 4


def test_http_failures_count_as_unknown_only_in_failure_tables(spark):
    rows = [(1, (False, None, "u", "external", None, 0, "d", None, "HTTP 500")),
            (2, (False, "x", "u", "external", "fallback", 1, "d", "SHORT_CONTENT", "short")),
            (3, (True, "t", "u", "external", "css_selector", 5, "d", None, None))]
    df = spark.createDataFrame(rows, "ord long, details " + S.DETAILS.simpleString())
    by_warning = {r["warning"]: r["n"] for r in ST.stats_by_warning(df).collect()}
    assert by_warning == {"SHORT_CONTENT": 1}
    failures = {r["warning"]: r["failures"] for r in ST.failures_by_warning(df).collect()}
    assert failures == {"UNKNOWN": 1, "SHORT_CONTENT": 1}


def test_search_history_null_safe(spark):
    found = [("q", None, None)]
    store = spark.createDataFrame([("r", None, None, None, None, None, None, None, None, found, None)],
                                  S.STORE)
    assert STO.has_search_history(store, "q", None)
    assert not STO.has_search_history(store, "q", "Berlin")
    assert STO.search_history_flags(store.where(F.lit(False)), {"x": ("q", None)}).collect()[0][0] is False
