"""Queries for responses and reasoning.

Binding: every assistant turn of `conversations` is one scored batch
(batch_no = conv_id * 1000000 + turn); its listing is the user turn just before
it, if there is one (ref 'JOB_<turn>', title 'turn <turn>', city 'c<conv_id>',
employer 'user').  The reasoning is the assistant text prefixed with a mention
of that listing ('[JOB_<turn-1>]') and a numeric reference '[<conv_id>-<turn>-A]'.
The response JSON carries the reasoning as text when conv_id % 3 = 0, as
reasoning details (a summary item, then one item per line) when conv_id % 3 = 1,
and none otherwise; there are no choices when conv_id % 5 = 4 and no usage when
conv_id % 4 = 3.  Content = the preceding user text.  Listing labels for C5:
Good Match when the user text is over 200 characters, else Poor Match.
Every row is built from at most two turns: no conversation is collected.
"""

from pyspark.sql import functions as F

from listforge.operators import reasoning as RS
from listforge.plans import bindings as B
from listforge.plans.registry import register

BASE = B.INTERNAL_BASE_URL
RUN = "reasoning-q"
SPAN = 1000000


def _turns(spark, sf):
    c = B.table(spark, sf, "conversations")
    a = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("a_text"))
    u = c.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("u_text"))
    # (conv_id, turn) is unique: a one-to-one join
    return a.join(u, ["conv_id", "turn"], "left").withColumn(
        "batch_no", F.col("conv_id") * SPAN + F.col("turn"))


def responses(spark, sf):
    t = _turns(spark, sf)
    piece = F.concat(F.lit("[JOB_"), (F.col("turn") - 1).cast("string"), F.lit("] ["),
                     F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
                     F.lit("-A] "), F.col("a_text"))
    details = F.concat(
        F.array(F.struct(F.lit("reasoning.summary").alias("type"), F.lit("summary").alias("text"))),
        F.transform(F.split(piece, "\n"),
                    lambda x: F.struct(F.lit("reasoning.text").alias("type"), x.alias("text"))))
    message = F.struct(F.col("u_text").alias("content"),
                       F.when(F.col("conv_id") % 3 == 0, piece).alias("reasoning"),
                       F.when(F.col("conv_id") % 3 == 1, details).alias("reasoning_details"))
    choices = F.when(F.col("conv_id") % 5 == 4, F.array()).otherwise(
        F.array(F.struct(message.alias("message"))))
    pt = F.coalesce(F.length("u_text"), F.lit(0))
    ct = F.length("a_text")
    usage = F.when(F.col("conv_id") % 4 != 3, F.struct(
        pt.alias("prompt_tokens"), ct.alias("completion_tokens"), (pt + ct).alias("total_tokens"),
        F.struct(F.lit(10).alias("reasoning_tokens")).alias("completion_tokens_details")))
    body = F.struct(F.concat(F.lit("resp-"), F.col("batch_no").cast("string")).alias("id"),
                    F.lit("stand-in-model").alias("model"), choices.alias("choices"),
                    usage.alias("usage"))
    return t.select(F.lit(RUN).alias("run_id"), "batch_no", F.col("u_text").alias("content"),
                    F.to_json(body).alias("raw_json"))


def batch_meta(spark, sf):
    t = _turns(spark, sf).where(F.col("u_text").isNotNull())
    return t.select(
        "batch_no",
        F.concat(F.lit("JOB_"), (F.col("turn") - 1).cast("string")).alias("ref_id"),
        F.concat(F.lit("turn "), (F.col("turn") - 1).cast("string")).alias("title"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("city"),
        F.lit("user").alias("employer"),
        F.when(F.length("u_text") > 200, F.array(F.lit("Good Match")))
        .otherwise(F.array(F.lit("Poor Match"))).alias("categories"),
        (F.col("batch_no") - 1).alias("ord"))


_WS = RS._WS
_STRIP = f"'^{_WS}+|{_WS}+$'"
_CONV = f"""
WITH a AS (SELECT conv_id, turn, text AS a_text FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn + 1 AS turn, text AS u_text FROM conversations WHERE role = 'user'),
t AS (SELECT a.conv_id, a.turn, a.a_text, u.u_text, a.conv_id * {SPAN} + a.turn AS batch_no,
             '[JOB_' || CAST(a.turn - 1 AS VARCHAR) || '] [' || CAST(a.conv_id AS VARCHAR) || '-'
               || CAST(a.turn AS VARCHAR) || '-A] ' || a.a_text AS piece
      FROM a LEFT JOIN u ON a.conv_id = u.conv_id AND a.turn = u.turn),
reason AS (
  SELECT conv_id, batch_no,
         CASE WHEN conv_id % 3 = 0 THEN regexp_replace(piece, {_STRIP}, '', 'g')
              ELSE array_to_string(list_filter(list_transform(string_split(piece, chr(10)),
                     lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: x <> ''), chr(10))
         END AS reasoning,
         CASE WHEN conv_id % 4 = 3 THEN 0 ELSE coalesce(length(u_text), 0) + length(a_text) END
           AS total_tokens,
         CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 10 END AS reasoning_tokens
  FROM t
  WHERE conv_id % 5 <> 4
    AND ((conv_id % 3 = 0 AND coalesce(piece, '') <> '') OR conv_id % 3 = 1)),
meta AS (SELECT batch_no, 'JOB_' || CAST(turn - 1 AS VARCHAR) AS ref_id,
                'turn ' || CAST(turn - 1 AS VARCHAR) AS title, 'c' || CAST(conv_id AS VARCHAR) AS city,
                'user' AS employer,
                CASE WHEN length(u_text) > 200 THEN 'Good Match' ELSE 'Poor Match' END AS category,
                batch_no - 1 AS ord
         FROM t WHERE u_text IS NOT NULL)
"""


@register("response_content", _CONV + """
SELECT batch_no, CASE WHEN conv_id % 5 = 4 THEN '' ELSE coalesce(u_text, '') END AS content FROM t""")
def q_response_content(spark, sf):
    return RS.response_content(responses(spark, sf)).select("batch_no", "content")


@register("extract_reasoning", _CONV + """
SELECT batch_no, 'stand-in-model' AS model, 'resp-' || CAST(batch_no AS VARCHAR) AS response_id,
       CAST(total_tokens AS BIGINT) AS total_tokens, CAST(reasoning_tokens AS BIGINT) AS reasoning_tokens,
       reasoning
FROM reason""")
def q_extract_reasoning(spark, sf):
    return RS.extract_reasoning(responses(spark, sf)).drop("run_id")


_USAGE = """
SELECT batch_no,
       CAST(CASE WHEN conv_id % 4 = 3 THEN 0 ELSE coalesce(length(u_text), 0) END AS BIGINT)
         AS prompt_tokens,
       CAST(CASE WHEN conv_id % 4 = 3 THEN 0 ELSE length(a_text) END AS BIGINT) AS completion_tokens,
       CAST(CASE WHEN conv_id % 4 = 3 THEN 0 ELSE coalesce(length(u_text), 0) + length(a_text) END
            AS BIGINT) AS total_tokens,
       CAST(CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 10 END AS BIGINT) AS reasoning_tokens
FROM t"""


@register("token_usage", _CONV + _USAGE)
def q_token_usage(spark, sf):
    return RS.token_usage(responses(spark, sf)).drop("run_id")


@register("token_totals", _CONV + f""",
usage AS ({_USAGE})
SELECT CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(count(*) AS BIGINT) AS batches
FROM usage""")
def q_token_totals(spark, sf):
    """Totals per run."""
    return RS.token_totals(responses(spark, sf)).drop("run_id")


@register("resolve_mentions", _CONV + f""",
m AS (SELECT batch_no, unnest(regexp_extract_all(reasoning, '{RS.MENTION_PATTERN}', 1)) AS ref_id
      FROM reason)
SELECT m.batch_no, m.ref_id,
       CASE WHEN meta.ref_id IS NOT NULL THEN 'known'
            WHEN starts_with(m.ref_id, 'JOB_') THEN 'unresolved' ELSE 'link' END AS status,
       CASE WHEN meta.ref_id IS NOT NULL OR NOT starts_with(m.ref_id, 'JOB_')
            THEN '{BASE}/' || m.ref_id END AS link,
       CASE WHEN meta.ref_id IS NOT NULL
            THEN meta.title || ' | ' || meta.city || ' | ' || meta.employer END AS tooltip
FROM m LEFT JOIN meta ON meta.batch_no = m.batch_no AND meta.ref_id = m.ref_id""")
def q_resolve_mentions(spark, sf):
    out = RS.resolve_mentions(RS.extract_reasoning(responses(spark, sf)), batch_meta(spark, sf), BASE)
    return out.select("batch_no", "ref_id", "status", "link", "tooltip")


@register("index_jobs", _CONV + """,
sizes AS (SELECT batch_no, CAST(count(*) AS BIGINT) AS batch_size FROM meta GROUP BY batch_no)
SELECT meta.batch_no, ref_id, title, city, employer, batch_size
FROM meta JOIN sizes USING (batch_no)
WHERE batch_no IN (SELECT batch_no FROM reason)""")
def q_index_jobs(spark, sf):
    idx = RS.index_jobs(batch_meta(spark, sf), RS.extract_reasoning(responses(spark, sf)))
    return idx.select("batch_no", "ref_id", "title", "city", "employer", "batch_size")


@register("index_with_category", _CONV + """,
idx AS (SELECT batch_no, ref_id FROM meta WHERE batch_no IN (SELECT batch_no FROM reason)),
cat AS (SELECT ref_id, arg_max(category, ord) AS category FROM meta GROUP BY ref_id)
SELECT idx.batch_no, idx.ref_id, coalesce(cat.category, '') AS category
FROM idx LEFT JOIN cat USING (ref_id)""")
def q_index_with_category(spark, sf):
    meta = batch_meta(spark, sf)
    idx = RS.index_jobs(meta, RS.extract_reasoning(responses(spark, sf)))
    out = RS.index_with_category(idx.select("batch_no", "ref_id"), meta)
    return out.select("batch_no", "ref_id", "category")


@register("search_index", _CONV + """,
idx AS (SELECT meta.batch_no, meta.ref_id, meta.title, meta.city, meta.employer, meta.category
        FROM meta WHERE batch_no IN (SELECT batch_no FROM reason)),
hits AS (SELECT * FROM idx
         WHERE contains(lower(ref_id), 'job_1') OR contains(lower(title), 'job_1')
            OR contains(lower(city), 'job_1') OR contains(lower(employer), 'job_1')
            OR contains(lower(category), 'job_1'))
SELECT batch_no, ref_id, title, city, employer, category,
       CAST(count(*) OVER (PARTITION BY batch_no) AS BIGINT) AS visible_in_batch
FROM hits""")
def q_search_index(spark, sf):
    """B11 over the reasoning index (query 'JOB_1', trimmed and case-folded)."""
    from listforge.operators import filters as FL

    meta = batch_meta(spark, sf)
    idx = RS.index_jobs(meta, RS.extract_reasoning(responses(spark, sf))).withColumn(
        "category", F.array_join("categories", ", "))
    out = FL.search_index(idx, " JOB_1 ", ["ref_id", "title", "city", "employer", "category"])
    return out.select("batch_no", "ref_id", "title", "city", "employer", "category",
                      "visible_in_batch")
