"""Queries for batching and labelling.

Bindings:
- classify: all extracted document listings, profile = the text of benchmark item 0 (an
  argument: one row), the deterministic term-overlap scorer, plan ordered by ref;
- answers: per batch of all documents (ordered by doc_id, 70 per batch), one
  line per document that has a label; batches whose number is a multiple of 4
  also get a line for the out-of-range id 999 with an unknown label, batches
  with number 4k+1 repeat their first labelled id with two labels at the end.
"""

from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import extract as X
from listforge.operators import labels as L
from listforge.operators import stats as STS
from listforge.plans import bindings as B
from listforge.plans.oracle import DOC_LISTINGS, LABELLED, with_ctes
from listforge.plans.registry import register

BATCH = S.DEFAULT_BATCH_SIZE
WS = S.PY_WHITESPACE_CLASS


def profile_text(spark, sf, item_id: int = 0) -> str:
    row = B.table(spark, sf, "benchmark").where(F.col("item_id") == item_id).select("text").first()
    return row["text"] if row else ""


def ok_listings(spark, sf):
    """OK rows of the document store (B7): every listing with a successful extraction."""
    from listforge.plans.q_store import doc_store

    ok, _failed = X.split_outcomes(doc_store(spark, sf), B.INTERNAL_BASE_URL)
    return ok


_OK_SQL = with_ctes(DOC_LISTINGS, """
ok AS (SELECT ref_id, coalesce(title, '') AS title, coalesce(city, '') AS city,
              coalesce(employer, '') AS employer, d_text AS text
       FROM doc_listings WHERE d_success)""")

_PLAN_SQL = _OK_SQL + f""",
plan AS (SELECT *, CAST(row_number() OVER (ORDER BY ref_id) - 1 AS BIGINT) AS plan_idx FROM ok),
plan2 AS (SELECT *, CAST(plan_idx // {BATCH} + 1 AS INTEGER) AS batch_no,
                 CAST(plan_idx % {BATCH} AS INTEGER) AS batch_pos,
                 lpad(CAST(plan_idx % {BATCH} + 1 AS VARCHAR), 3, '0') AS short_id
          FROM plan)
"""


def _terms_sql(expr: str) -> str:
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all({expr}, '[A-Za-z]+'), "
            f"lambda x: lower(x)), lambda x: length(x) >= 4))")


def _classify_sql(item_id: int) -> str:
    return _PLAN_SQL + f""",
prof AS (SELECT {_terms_sql('text')} AS p FROM benchmark WHERE item_id = {item_id}),
scored AS (SELECT plan2.*, CAST(len(list_intersect({_terms_sql('text')}, prof.p)) AS DOUBLE)
                  / len(prof.p) AS share
           FROM plan2, prof)
SELECT ref_id, batch_no, short_id,
       CASE WHEN share >= 0.25 THEN 'Excellent Match' WHEN share >= 0.12 THEN 'Good Match'
            ELSE 'Poor Match' END AS category
FROM scored"""


@register("assign_batches", _PLAN_SQL + """
SELECT ref_id, plan_idx, batch_no, batch_pos, short_id FROM plan2""")
def q_assign_batches(spark, sf):
    plan = L.assign_batches(ok_listings(spark, sf), BATCH, ["ref_id"])
    return plan.select("ref_id", "plan_idx", "batch_no", "batch_pos", "short_id")


@register("batch_plan_summary", _PLAN_SQL + """
SELECT batch_no, CAST(count(*) AS BIGINT) AS batch_rows FROM plan2 GROUP BY batch_no""")
def q_batch_plan_summary(spark, sf):
    return L.batch_plan_summary(L.assign_batches(ok_listings(spark, sf), BATCH, ["ref_id"]))


def _prompt_sql() -> str:
    header = L.DEFAULT_TEMPLATE.head_for(S.CATEGORIES, "\x00").replace("'", "''")
    opening, between, closing = L.DEFAULT_TEMPLATE.frame()
    before, after = header.split("\x00")
    profile = f"regexp_replace((SELECT text FROM benchmark WHERE item_id = 0), '^{WS}+|{WS}+$', '', 'g')"
    footer = L.DEFAULT_TEMPLATE.tail.replace("'", "''")
    return _PLAN_SQL + f"""
SELECT batch_no, CAST(count(*) AS INTEGER) AS n_items,
       '{before}' || {profile} || '{after}'
       || string_agg('{opening}' || short_id || '{between}' || coalesce(text, '') || '{closing}', ''
                     ORDER BY batch_pos)
       || '{footer}' AS prompt
FROM plan2 GROUP BY batch_no"""


@register("build_batch_prompt", _prompt_sql())
def q_build_batch_prompt(spark, sf):
    plan = L.assign_batches(ok_listings(spark, sf), BATCH, ["ref_id"])
    return L.build_batch_prompts(plan, profile_text(spark, sf)).select("batch_no", "n_items", "prompt")


@register("classify", _classify_sql(0))
def q_classify(spark, sf):
    """J8 end to end with the deterministic scorer; every batch must validate."""
    profile = profile_text(spark, sf)
    res = L.classify(ok_listings(spark, sf), L.TermOverlapScorer(profile), profile, "classify-q",
                     batch_size=BATCH, order_cols=["ref_id"])
    L.raise_on_violations(res)
    return res.labelled.select("ref_id", "batch_no", "short_id",
                               F.array_join("categories", ", ").alias("category"))


# --- answers built from `labels` -------------------------------------------------
def answer_plan(spark, sf):
    docs = B.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("ref_id"), F.col("doc_id").alias("ord"), "text")
    return L.assign_batches(docs, BATCH, ["ord"])


def answers(spark, sf):
    plan = answer_plan(spark, sf)
    labels = B.table(spark, sf, "labels")
    lab = plan.join(labels, plan["ord"] == labels["doc_id"], "inner").select(
        "batch_no", "batch_pos", "short_id",
        B.label_category(F.col("quality"), F.col("toxic")).alias("category"))
    per_batch = lab.groupBy("batch_no").agg(
        F.array_sort(F.collect_list(F.struct("batch_pos", "short_id", "category"))).alias("items"))
    lines = F.transform("items", lambda x: F.concat(F.lit("["), x["short_id"], F.lit("] - "),
                                                    x["category"]))
    first = F.element_at("items", 1)
    extra = (F.when(F.col("batch_no") % 4 == 0, F.array(F.lit("[999] - Unsure")))
             .when(F.col("batch_no") % 4 == 1, F.array(F.concat(
                 F.lit("  ["), first["short_id"], F.lit("]-Poor Match ,Good Match  "))))
             .otherwise(F.array().cast("array<string>")))
    content = F.array_join(F.concat(F.array(F.lit("Here are the labels:")), lines, extra), "\n")
    return per_batch.select(F.lit("answers-q").alias("run_id"), F.col("batch_no").cast("int"),
                            content.alias("content"), F.lit(None).cast("string").alias("raw_json"))


_ANS_SQL = f"""
WITH plan AS (
  SELECT CAST(doc_id AS VARCHAR) AS ref_id, doc_id AS ord,
         CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} + 1 AS INTEGER) AS batch_no,
         CAST((row_number() OVER (ORDER BY doc_id) - 1) % {BATCH} AS INTEGER) AS batch_pos
  FROM documents),
plan2 AS (SELECT *, lpad(CAST(batch_pos + 1 AS VARCHAR), 3, '0') AS short_id FROM plan),
lab AS (SELECT p.*, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Excellent Match'
                         WHEN l.quality = 1 THEN 'Good Match' ELSE 'Poor Match' END AS category
        FROM plan2 p JOIN labels l ON p.ord = l.doc_id),
firsts AS (SELECT batch_no, arg_min(short_id, batch_pos) AS short_id FROM lab GROUP BY batch_no),
parsed AS (
  SELECT batch_no, short_id, category AS categories FROM lab
  WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.batch_no = lab.batch_no
                    AND f.short_id = lab.short_id AND lab.batch_no % 4 = 1)
  UNION ALL
  SELECT batch_no, short_id, 'Poor Match, Good Match' FROM firsts WHERE batch_no % 4 = 1
  UNION ALL
  SELECT batch_no, '999', 'Unsure' FROM firsts WHERE batch_no % 4 = 0)
"""


@register("parse_labels", _ANS_SQL + """
SELECT batch_no, short_id, categories FROM parsed""")
def q_parse_labels(spark, sf):
    best = L.last_labels(L.parse_lines(answers(spark, sf)))
    return best.select("batch_no", "short_id", F.array_join("categories", ", ").alias("categories"))


@register("invalid_labels", _ANS_SQL + """
SELECT batch_no, '999' AS short_id, 'Unsure' AS bad_labels FROM firsts WHERE batch_no % 4 = 0""")
def q_invalid_labels(spark, sf):
    bad = L.invalid_labels(L.parse_lines(answers(spark, sf)))
    return bad.select("batch_no", "short_id", F.array_join("bad_labels", ", ").alias("bad_labels"))


@register("missing_in_batch", _ANS_SQL + """
SELECT p.batch_no, p.short_id, p.ref_id FROM plan2 p
WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.batch_no = p.batch_no AND l.short_id = p.short_id)""")
def q_missing_in_batch(spark, sf):
    best = L.last_labels(L.parse_lines(answers(spark, sf)))
    return L.missing_in_batch(answer_plan(spark, sf), best)


@register("apply_labels", _ANS_SQL + """
SELECT p.ref_id, p.batch_no, p.short_id, x.categories AS category
FROM plan2 p JOIN parsed x ON p.batch_no = x.batch_no AND p.short_id = x.short_id""")
def q_apply_labels(spark, sf):
    best = L.last_labels(L.parse_lines(answers(spark, sf)))
    out = L.apply_labels(answer_plan(spark, sf), best)
    return out.select("ref_id", "batch_no", "short_id",
                      F.array_join("categories", ", ").alias("category"))


@register("match_split", with_ctes(DOC_LISTINGS, LABELLED) + """
SELECT CAST(count(*) AS BIGINT) AS labelled,
       CAST(count_if(category IN ('Excellent Match', 'Good Match')) AS BIGINT) AS matches,
       CAST(count_if(category = 'Excellent Match') AS BIGINT) AS excellent,
       CAST(count_if(category = 'Good Match') AS BIGINT) AS good
FROM labelled""")
def q_match_split(spark, sf):
    return STS.match_split(B.labelled_listings(spark, sf))
