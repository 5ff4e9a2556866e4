"""Queries for the keyed store.

Binding (SURVEY §5.3): `events` is a change feed.  ref = user_id || '-' || props.k,
arrival order = event_id, stamp = the event's date as text.  Events before
2024-01-16 are merged into an empty store (query 'q-early'); the later events
are then merged into that store (query 'q-late').  Same place both times.
"""

from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import filters as FL
from listforge.operators import stats as STS
from listforge.operators import store as ST
from listforge.operators import store_stats as SS
from listforge.plans import bindings as B
from listforge.plans.oracle import DOC_LISTINGS, with_ctes
from listforge.plans.registry import register
from listforge.session import materialize, scratch_path
from listforge.sources import store_io as IO

CUT = B.STORE_CUTOFF
AS_OF_1 = CUT
AS_OF_2 = B.AS_OF
Q1, Q2 = "q-early", "q-late"
PLACE = B.PLACE
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def event_listings(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.get_json_object("props", "$.k")).alias("ref_id"),
        F.col("event_type").alias("title"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("employer"),
        F.struct(F.col("user_id").cast("string").alias("city")).alias("location"),
        F.lit(None).cast("string").alias("external_url"),
        F.date_format("ts", "yyyy-MM-dd").alias("modified_at"),
        F.to_date("ts").alias("published_on"),
        F.col("event_id").cast("long").alias("batch_ord"),
        "ts", "value", "props",
    )


def two_merges(spark, sf):
    """Merge the early events into an empty store, save it, merge the late events.

    As in a real run, the second merge reads the saved store (the buckets it touches), so the
    plans stay one merge deep.  Returns the merges, the late events and the store's folder.
    """
    ev = event_listings(spark, sf)
    early = ev.where(F.col("ts") < F.lit(CUT).cast("timestamp"))
    late = ev.where(F.col("ts") >= F.lit(CUT).cast("timestamp"))
    root = scratch_path(spark, "store")
    m1 = ST.merge_listings(ST.empty_store(spark), early, Q1, PLACE, AS_OF_1)
    meta1 = {"created": None, "place": PLACE, "radius_km": B.RADIUS_KM}
    IO.save_store(spark, root, m1.store,
                  lambda written: ST.store_metadata(written, meta1, AS_OF_1, PLACE, B.RADIUS_KM))
    m2 = ST.merge_saved(spark, root, late, Q2, PLACE, AS_OF_2)
    return m2, late, root


def saved_twice(spark, sf):
    """The store after both merges, the second of which wrote its buckets only."""
    m2, _late, root = two_merges(spark, sf)
    previous = IO.load_metadata(spark, root)
    IO.save_touched(spark, root, m2.store,
                    lambda written: ST.store_metadata(written, previous, AS_OF_2, PLACE, B.RADIUS_KM))
    return m2, IO.load_store(spark, root), root


def searches_col(found_in):
    return F.array_join(F.transform(found_in, lambda s: F.concat_ws(
        "@", s["query"], s["place"], F.date_format(s["first_match"], TS_FMT))), "|")


def store_view(store):
    return store.select(
        "ref_id", "title", "employer", F.col("location.city").alias("city"), "modified_at",
        F.date_format("published_on", "yyyy-MM-dd").alias("published_on"),
        F.date_format("first_seen", TS_FMT).alias("first_seen"),
        F.date_format("last_seen", TS_FMT).alias("last_seen"),
        searches_col(F.col("found_in")).alias("searches"),
        F.col("details").isNotNull().alias("has_details"),
    )


# --- DuckDB twin: a plain sequential window per ref ------------------------------
_EV = f"""
ev AS (
  SELECT event_id AS batch_ord,
         CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k') AS ref_id,
         strftime(ts, '%Y-%m-%d') AS modified_at, event_type AS title,
         'user-' || CAST(user_id AS VARCHAR) AS employer, CAST(user_id AS VARCHAR) AS city,
         strftime(ts, '%Y-%m-%d') AS published_on, ts, value, props
  FROM events),
b1 AS (SELECT * FROM ev WHERE ts < TIMESTAMP '{CUT}'),
b2 AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '{CUT}'),
m1 AS (
  SELECT *, CASE WHEN rn = 1 THEN 'new'
                 WHEN stamp IS NOT NULL AND prior IS DISTINCT FROM stamp THEN 'updated'
                 ELSE 'unchanged' END AS status
  FROM (SELECT *, nullif(modified_at, '') AS stamp,
               row_number() OVER (PARTITION BY ref_id ORDER BY batch_ord) AS rn,
               last_value(nullif(modified_at, '') IGNORE NULLS) OVER (
                 PARTITION BY ref_id ORDER BY batch_ord
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
        FROM b1)),
eff1 AS (SELECT ref_id, max(batch_ord) FILTER (WHERE status IN ('new', 'updated')) AS eff_ord
         FROM m1 GROUP BY ref_id),
store1 AS (
  SELECT b.ref_id, b.title, b.employer, b.city, b.modified_at, b.published_on,
         '{AS_OF_1}' AS first_seen, '{AS_OF_1}' AS last_seen,
         ['{Q1}@{PLACE}@{AS_OF_1}'] AS searches, false AS has_details
  FROM eff1 JOIN b1 b ON b.ref_id = eff1.ref_id AND b.batch_ord = eff1.eff_ord),
seq2 AS (
  SELECT ref_id, CAST(-1 AS BIGINT) AS batch_ord, nullif(modified_at, '') AS stamp, true AS is_store
  FROM store1 WHERE ref_id IN (SELECT ref_id FROM b2)
  UNION ALL
  SELECT ref_id, batch_ord, nullif(modified_at, ''), false FROM b2),
m2 AS (
  SELECT *, CASE WHEN rn = 1 THEN 'new'
                 WHEN stamp IS NOT NULL AND prior IS DISTINCT FROM stamp THEN 'updated'
                 ELSE 'unchanged' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY batch_ord) AS rn,
               last_value(stamp IGNORE NULLS) OVER (
                 PARTITION BY ref_id ORDER BY batch_ord
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
        FROM seq2)),
c2 AS (SELECT * FROM m2 WHERE NOT is_store),
per2 AS (SELECT ref_id,
                max(batch_ord) FILTER (WHERE NOT is_store AND status IN ('new', 'updated')) AS eff_ord,
                bool_or(is_store) AS in_store
         FROM m2 GROUP BY ref_id),
touched AS (
  SELECT p.ref_id, p.eff_ord, p.in_store, b.title, b.employer, b.city, b.modified_at,
         b.published_on
  FROM per2 p LEFT JOIN b2 b ON b.ref_id = p.ref_id AND b.batch_ord = p.eff_ord),
store2 AS (
  SELECT s.ref_id,
         CASE WHEN t.eff_ord IS NOT NULL THEN t.title ELSE s.title END AS title,
         CASE WHEN t.eff_ord IS NOT NULL THEN t.employer ELSE s.employer END AS employer,
         CASE WHEN t.eff_ord IS NOT NULL THEN t.city ELSE s.city END AS city,
         CASE WHEN t.eff_ord IS NOT NULL THEN t.modified_at ELSE s.modified_at END AS modified_at,
         CASE WHEN t.eff_ord IS NOT NULL THEN t.published_on ELSE s.published_on END
           AS published_on,
         s.first_seen,
         CASE WHEN t.ref_id IS NOT NULL THEN '{AS_OF_2}' ELSE s.last_seen END AS last_seen,
         CASE WHEN t.ref_id IS NOT NULL AND NOT list_contains(
                     list_transform(s.searches, lambda x: split_part(x, '@', 1) || '@' || split_part(x, '@', 2)),
                     '{Q2}@{PLACE}')
              THEN list_append(s.searches, '{Q2}@{PLACE}@{AS_OF_2}') ELSE s.searches END AS searches,
         CASE WHEN t.eff_ord IS NOT NULL THEN false ELSE s.has_details END AS has_details
  FROM store1 s LEFT JOIN touched t ON s.ref_id = t.ref_id
  UNION ALL
  SELECT ref_id, title, employer, city, modified_at, published_on,
         '{AS_OF_2}', '{AS_OF_2}', ['{Q2}@{PLACE}@{AS_OF_2}'], false
  FROM touched WHERE NOT in_store)"""

_MERGE_SQL = with_ctes(_EV)


@register("merge_listings", _MERGE_SQL + """
SELECT ref_id, title, employer, city, modified_at, published_on, first_seen, last_seen,
       array_to_string(searches, '|') AS searches, has_details
FROM store2""")
def q_merge_listings(spark, sf):
    _m2, store, _root = saved_twice(spark, sf)
    return store_view(store)


@register("prior_stamp", _MERGE_SQL + """
SELECT ref_id, batch_ord, prior AS prior_stamp, status FROM c2""")
def q_prior_stamp(spark, sf):
    m2, _late, _root = two_merges(spark, sf)
    return m2.classified.select("ref_id", "batch_ord", "prior_stamp", "status")


@register("effective_payload", _MERGE_SQL + """
SELECT ref_id, eff_ord, in_store FROM per2""")
def q_effective_payload(spark, sf):
    m2, _late, _root = two_merges(spark, sf)
    return m2.per_ref.select("ref_id", "eff_ord", "in_store")


@register("append_search", _MERGE_SQL + """
SELECT ref_id, array_to_string(searches, '|') AS searches, CAST(len(searches) AS BIGINT) AS n_searches
FROM store2""")
def q_append_search(spark, sf):
    _m2, store, _root = saved_twice(spark, sf)
    return store.select("ref_id", searches_col(F.col("found_in")).alias("searches"),
                           F.size("found_in").cast("long").alias("n_searches"))


@register("delta_summary", _MERGE_SQL + """
SELECT CAST(count(DISTINCT ref_id) FILTER (WHERE status = 'new') AS BIGINT) AS new,
       CAST(count(DISTINCT ref_id) FILTER (WHERE status = 'updated') AS BIGINT) AS updated,
       CAST(count(DISTINCT ref_id) FILTER (WHERE status = 'unchanged') AS BIGINT) AS unchanged,
       (SELECT CAST(count(*) AS BIGINT) FROM store2) AS total_in_store
FROM c2""")
def q_delta_summary(spark, sf):
    m2, store, _root = saved_twice(spark, sf)
    return ST.delta_summary(m2.per_ref, store)


@register("to_process", _MERGE_SQL + """
SELECT ref_id, batch_ord, status, CASE WHEN status = 'new' THEN 0 ELSE 1 END AS process_ord
FROM c2 WHERE status IN ('new', 'updated')""")
def q_to_process(spark, sf):
    m2, _late, _root = two_merges(spark, sf)
    return m2.to_process().select("ref_id", "batch_ord", "status", "process_ord")


def _seen_sql(query: str, place: str) -> str:
    return (f"coalesce(bool_or(list_contains(list_transform(searches, lambda x: split_part(x, '@', 1) || '@' || "
            f"split_part(x, '@', 2)), '{query}@{place}')), false)")


@register("has_search_history", _MERGE_SQL + f"""
SELECT {_seen_sql(Q1, PLACE)} AS early_seen, {_seen_sql(Q2, PLACE)} AS late_seen,
       {_seen_sql(Q1, 'Hamburg')} AS other_place_seen
FROM store2""")
def q_has_search_history(spark, sf):
    """C6 on the store after both merges."""
    _m2, store, _root = saved_twice(spark, sf)
    return ST.search_history_flags(store, {
        "early_seen": (Q1, PLACE), "late_seen": (Q2, PLACE), "other_place_seen": (Q1, "Hamburg")})


@register("incremental_window", _MERGE_SQL + f"""
SELECT CASE WHEN {_seen_sql(Q1, PLACE)} THEN {S.DEFAULT_INCREMENTAL_DAYS} END AS days_repeat_search,
       CASE WHEN {_seen_sql('q-never', PLACE)} THEN {S.DEFAULT_INCREMENTAL_DAYS} END AS days_new_search,
       3 AS days_explicit
FROM store2""")
def q_incremental_window(spark, sf):
    """B4 on the store after both merges: a repeated search gets the default window, a new one none."""
    _m2, store, _root = saved_twice(spark, sf)
    none, exists = F.lit(None).cast("int"), F.lit(True)
    seen = ST.search_history_flags(store, {"again": (Q1, PLACE), "new": ("q-never", PLACE)})
    return seen.select(
        FL.incremental_window_col(none, exists, F.col("again")).alias("days_repeat_search"),
        FL.incremental_window_col(none, exists, F.col("new")).alias("days_new_search"),
        F.lit(FL.incremental_window(3, True, True)).alias("days_explicit"))


@register("store_metadata", _MERGE_SQL + f"""
SELECT '{AS_OF_1}' AS created, '{AS_OF_2}' AS last_updated,
       CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS active,
       '{PLACE}' AS place, {B.RADIUS_KM} AS radius_km
FROM store2""")
def q_store_metadata(spark, sf):
    """E15 as the second save recorded it."""
    _m2, _store, root = saved_twice(spark, sf)
    ST.check_context(IO.load_metadata(spark, root), PLACE, B.RADIUS_KM)
    meta = spark.read.parquet(f"{root}/meta").where("save = 2")
    return meta.select(F.date_format("created", TS_FMT).alias("created"),
                       F.date_format("last_updated", TS_FMT).alias("last_updated"),
                       "total", "active", "place", "radius_km")


@register("attach_details", _MERGE_SQL + """,
det AS (SELECT c.ref_id, arg_max(b.value, c.batch_ord) AS value, arg_max(b.props, c.batch_ord) AS props
        FROM c2 c JOIN b2 b ON b.batch_ord = c.batch_ord
        WHERE c.status IN ('new', 'updated') GROUP BY c.ref_id)
SELECT s.ref_id, (d.ref_id IS NOT NULL) OR s.has_details AS has_details,
       d.value >= 10 AS d_success, d.props AS d_text
FROM store2 s LEFT JOIN det d USING (ref_id)""")
def q_attach_details(spark, sf):
    """Details for the processed rows (success when value >= 10, text = props)."""
    m2, _late, root = two_merges(spark, sf)
    proc = m2.to_process().select("ref_id", "batch_ord", "value", "props")
    det = proc.select("ref_id", "batch_ord", F.struct(
        (F.col("value") >= 10).alias("success"), F.col("props").alias("text"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.DETAILS.fields[2:]]
    ).alias("details"))
    IO.save_touched(spark, root, ST.attach_details(m2.store, det), lambda written: ST.store_metadata(
        written, {"created": AS_OF_1, "place": PLACE, "radius_km": B.RADIUS_KM}, AS_OF_2, PLACE, B.RADIUS_KM))
    return IO.load_store(spark, root).select("ref_id", F.col("details").isNotNull().alias("has_details"),
                      F.col("details.success").alias("d_success"),
                      F.col("details.text").alias("d_text"))


# --- B14 / B15 on a store made from the documents binding ---------------------------
def doc_store(spark, sf):
    d = B.doc_listings(spark, sf)
    return d.select(
        "ref_id", "title", "employer", "location", "external_url",
        F.lit(None).cast("string").alias("modified_at"),
        F.lit(None).cast("date").alias("published_on"),
        F.lit(AS_OF_1).cast("timestamp").alias("first_seen"),
        F.lit(AS_OF_1).cast("timestamp").alias("last_seen"),
        F.lit(None).cast(S.FOUND_IN).alias("found_in"),
        "details",
    )


_DOC = with_ctes(DOC_LISTINGS)


@register("disable_listing", _DOC + f"""
SELECT ref_id,
       CASE WHEN length(d_text) > {S.MAX_TEXT_CHARS} THEN false ELSE d_success END AS success,
       CASE WHEN length(d_text) > {S.MAX_TEXT_CHARS} THEN '{S.WARN_EXCESSIVE_CONTENT}'
            ELSE d_warning END AS warning,
       CASE WHEN length(d_text) > {S.MAX_TEXT_CHARS} THEN '{S.DEFAULT_DISABLE_REASON}'
            ELSE d_error END AS error,
       CASE WHEN length(d_text) > {S.MAX_TEXT_CHARS} THEN CAST({len(S.DEFAULT_DISABLE_REASON)} AS BIGINT)
            ELSE d_text_length END AS text_length
FROM doc_listings""")
def q_disable_listing(spark, sf):
    """Every listing whose text would be cut is disabled with the default reason."""
    store = doc_store(spark, sf)
    oversize = FL.size_guard(store.select("ref_id", F.col("details.text").alias("text")))
    new_store, _report = FL.disable_listing(store, oversize.select("ref_id"))
    return new_store.select("ref_id", "details.success", "details.warning", "details.error",
                            "details.text_length")


@register("get_listing", _DOC + """
SELECT ref_id, title, employer, d_text_length AS text_length
FROM doc_listings WHERE ref_id = '42'""")
def q_get_listing(spark, sf):
    """B15 on the saved store: one bucket is read."""
    root = scratch_path(spark, "store")
    IO.save_store(spark, root, doc_store(spark, sf),
                  lambda written: ST.store_metadata(written, None, AS_OF_1, PLACE, B.RADIUS_KM))
    got = IO.find_listing(spark, root, "42")
    return got.select("ref_id", "title", "employer", F.col("details.text_length").alias("text_length"))


@register("all_listings", _DOC + """
SELECT ref_id, title, employer, city FROM doc_listings""")
def q_all_listings(spark, sf):
    s = doc_store(spark, sf)
    return s.select("ref_id", "title", "employer", F.col("location.city").alias("city"))


@register("save_store", _DOC + f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS active,
       '{PLACE}' AS place, {B.RADIUS_KM} AS radius_km, '{AS_OF_1}' AS created
FROM doc_listings""")
def q_save_store(spark, sf):
    """A4: the document store written in buckets; its metadata row read back."""
    store = doc_store(spark, sf)
    root = scratch_path(spark, "store")
    IO.save_store(spark, root, store,
                  lambda written: ST.store_metadata(written, None, AS_OF_1, PLACE, B.RADIUS_KM))
    meta = spark.read.parquet(f"{root}/meta")
    return meta.select("total", "active", "place", "radius_km",
                       F.date_format("created", TS_FMT).alias("created"))


@register("load_store", _DOC + """
SELECT ref_id, title, employer, city, d_text_length AS text_length FROM doc_listings""")
def q_load_store(spark, sf):
    """A3: a missing store loads empty; a saved one loads whole."""
    root = scratch_path(spark, "store")
    empty = IO.load_store(spark, root)
    store = doc_store(spark, sf)
    IO.save_store(spark, root, store,
                  lambda written: ST.store_metadata(written, None, AS_OF_1, PLACE, B.RADIUS_KM))
    loaded = empty.unionByName(IO.load_store(spark, root))
    return loaded.select("ref_id", "title", "employer", F.col("location.city").alias("city"),
                         F.col("details.text_length").alias("text_length"))


@register("stored_stats", _DOC + f"""
, dv AS (
  SELECT coalesce(d_source, 'unknown') AS source, coalesce(city = 'de', false) AS off, d_success, d_warning, d_text_length
  FROM doc_listings),
v AS (SELECT source, CASE WHEN off THEN false ELSE coalesce(d_success, false) END AS success,
             CASE WHEN off THEN '{S.WARN_EXCESSIVE_CONTENT}' ELSE d_warning END AS warning,
             CASE WHEN off THEN {len(S.DEFAULT_DISABLE_REASON)} ELSE d_text_length END AS chars FROM dv)
SELECT 'source:' || source AS item, CAST(count(*) AS BIGINT) AS n, CAST(count_if(success) AS BIGINT) AS successful,
       CAST(floor(sum(chars) / count(*)) AS BIGINT) AS avg_text_length FROM v GROUP BY source
UNION ALL
SELECT 'warning:' || warning, count(*), NULL, NULL FROM v WHERE coalesce(warning, '') <> '' GROUP BY warning""")
def q_stored_stats(spark, sf):
    """E5 and E8 from the store's partials, after German listings were disabled in their buckets."""
    root = scratch_path(spark, "store")
    meta = lambda written: ST.store_metadata(written, None, AS_OF_1, PLACE, B.RADIUS_KM)
    IO.save_store(spark, root, doc_store(spark, sf), meta)
    SS.refresh_stats(spark, root)
    off = IO.load_store(spark, root).where(F.col("location.city") == "de").select("ref_id")
    touched = IO.touched_buckets(spark, root, off)
    rows, _report = FL.disable_listing(IO.load_store(spark, root, touched), materialize(off, "disable"))
    IO.save_touched(spark, root, rows, meta)
    SS.refresh_stats(spark, root, touched)
    stats = SS.store_partials(spark, root)
    by_source = STS.stats_by_source(stats).select(F.concat(F.lit("source:"), "source").alias("item"), F.col("total").alias("n"),
                                                  "successful", "avg_text_length")
    by_warning = STS.stats_by_warning(stats).select(F.concat(F.lit("warning:"), "warning").alias("item"), "n",
                                                    F.lit(None).cast("long"), F.lit(None).cast("long"))
    return by_source.union(by_warning)
