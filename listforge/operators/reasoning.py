"""Scorer responses: content, reasoning, token usage and mention links (J5, J6, E16,
C5, C7, C8).

Responses are RESPONSE rows whose ``raw_json`` is the provider's JSON; it is
parsed once with an explicit schema.  Batch metadata (which listing sat in
which batch) is a plain DataFrame (batch_no, ref_id, title, city, employer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge import schemas as S

# mention forms inside reasoning text: [digits-digits-LETTER] or [JOB_n]
MENTION_PATTERN = r"\[([0-9]+-[0-9]+-[A-Z]|JOB_[0-9]+)\]"
_WS = S.PY_WHITESPACE_CLASS
_DETAILS_ARRAY = "array<struct<type:string,text:string>>"


def _strip(col):
    return F.regexp_replace(col, f"^{_WS}+|{_WS}+$", "")


def parse_response(responses: DataFrame) -> DataFrame:
    """Adds ``r``: the parsed response JSON."""
    return responses.withColumn("r", F.from_json(F.col("raw_json"), S.RESPONSE_JSON))


def response_content(responses: DataFrame) -> DataFrame:
    """The first choice's message content, '' when absent."""
    p = parse_response(responses)
    first = F.get(F.col("r.choices"), 0)
    return p.select("run_id", "batch_no",
                    F.coalesce(first["message"]["content"], F.lit("")).alias("content"))


def extract_reasoning(responses: DataFrame) -> DataFrame:
    """Model, id, tokens and reasoning text; no row when a response has none.

    The reasoning text is the message's ``reasoning`` (stripped) when non-empty,
    else the stripped, non-empty texts of details of type ``reasoning.text``
    joined by newlines.
    """
    p = parse_response(responses)
    msg = F.get(F.col("r.choices"), 0)["message"]
    details = F.coalesce(msg["reasoning_details"], F.array().cast(_DETAILS_ARRAY))
    detail_texts = F.filter(
        F.transform(F.filter(details, lambda d: d["type"] == "reasoning.text"),
                    lambda d: _strip(F.coalesce(d["text"], F.lit("")))),
        lambda t: t != "")
    has_text = F.coalesce(msg["reasoning"], F.lit("")) != ""
    has_details = F.size(details) > 0
    text = F.when(has_text, _strip(msg["reasoning"])).otherwise(F.array_join(detail_texts, "\n"))
    return p.where(F.size(F.coalesce(F.col("r.choices"), F.array())) > 0) \
        .where(has_text | has_details).select(
            "run_id", "batch_no",
            F.coalesce(F.col("r.model"), F.lit("unknown")).alias("model"),
            F.coalesce(F.col("r.id"), F.lit("unknown")).alias("response_id"),
            F.coalesce(F.col("r.usage.total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
            F.coalesce(F.col("r.usage.completion_tokens_details.reasoning_tokens"), F.lit(0))
            .cast("long").alias("reasoning_tokens"),
            text.alias("reasoning"))


def token_usage(responses: DataFrame) -> DataFrame:
    """Prompt + completion tokens per batch (missing usage counts 0)."""
    p = parse_response(responses)
    pt = F.coalesce(F.col("r.usage.prompt_tokens"), F.lit(0)).cast("long")
    ct = F.coalesce(F.col("r.usage.completion_tokens"), F.lit(0)).cast("long")
    rt = F.coalesce(F.col("r.usage.completion_tokens_details.reasoning_tokens"), F.lit(0)).cast("long")
    return p.select("run_id", "batch_no", pt.alias("prompt_tokens"), ct.alias("completion_tokens"),
                    (pt + ct).alias("total_tokens"), rt.alias("reasoning_tokens"))


def token_totals(responses: DataFrame) -> DataFrame:
    """Totals per run."""
    return token_usage(responses).groupBy("run_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in
          ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens")],
        F.count(F.lit(1)).alias("batches"))


def resolve_mentions(reasoning: DataFrame, batch_meta: DataFrame, base_url: str) -> DataFrame:
    """Every mention in a reasoning text, resolved against its batch's listings.

    status: 'known' (title/city/employer and link), 'link' (unknown numeric
    ref: link only), 'unresolved' (unknown JOB_n).
    """
    found = reasoning.select("batch_no", F.posexplode(
        F.regexp_extract_all(F.col("reasoning"), F.lit(MENTION_PATTERN), 1)).alias("mention_no",
                                                                                 "ref_id"))
    # the last listing of a repeated ref counts (by position in the batch, if there is one)
    order = F.struct(F.col("batch_pos") if "batch_pos" in batch_meta.columns else F.lit(0),
                     F.xxhash64("title", "city", "employer"))
    meta = batch_meta.groupBy("batch_no", "ref_id").agg(
        F.max_by(F.struct("title", "city", "employer"), order).alias("m")).select(
        "batch_no", "ref_id", "m.*", F.lit(True).alias("_known"))
    j = found.join(meta, ["batch_no", "ref_id"], "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    is_job = F.col("ref_id").startswith("JOB_")
    status = F.when(known, F.lit("known")).when(is_job, F.lit("unresolved")).otherwise(F.lit("link"))
    link = F.when(known | ~is_job, F.concat(F.lit(base_url + "/"), F.col("ref_id")))
    tooltip = F.when(known, F.concat_ws(" | ", F.coalesce("title", F.lit("N/A")),
                                        F.coalesce("city", F.lit("N/A")),
                                        F.coalesce("employer", F.lit("N/A"))))
    return j.select("batch_no", "mention_no", "ref_id", status.alias("status"), link.alias("link"),
                    tooltip.alias("tooltip"))


def index_jobs(batch_meta: DataFrame, reasoning: DataFrame) -> DataFrame:
    """Listings of batches that have reasoning, with the batch size."""
    sizes = batch_meta.groupBy("batch_no").agg(F.count(F.lit(1)).alias("batch_size"))
    with_reasoning = reasoning.select("batch_no").distinct()
    return (batch_meta.join(with_reasoning, "batch_no", "left_semi")
            .join(sizes, "batch_no"))


def index_with_category(index: DataFrame, labelled: DataFrame) -> DataFrame:
    """Index rows with the joined category text of their ref ('' when none).

    ``labelled`` has ref_id, categories and ``ord``; for a ref labelled more
    than once the last one (by ord) wins.  Refs without categories are skipped.
    """
    cat = (labelled.where((F.coalesce("ref_id", F.lit("")) != "")
                          & (F.size(F.coalesce("categories", F.array())) > 0))
           .groupBy("ref_id").agg(F.max_by(F.array_join("categories", ", "), "ord")
                                  .alias("category")))
    return index.join(cat, "ref_id", "left").withColumn(
        "category", F.coalesce(F.col("category"), F.lit("")))
