"""Batched labelling with strict integrity checks.

Flow of ``classify``: size guard (B13, if a limit is given) -> batch plan (F2, dense
positions via partition offsets, no single-task window) -> the scorer answers each batch
(J2, a bounded group: at most 999 rows) on the JVM or in ``mapInPandas`` -> answers are made durable (P5) -> parse (J3), label check (J4),
missing-position check (H3) -> labels join back to the plan (C4).  A batch is
all or nothing: any violation fails the whole batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators.filters import OversizeTextError, size_guard
from listforge.operators.indexing import row_positions
from listforge.session import materialize, scratch_path, ship_package


class LabelIntegrityError(RuntimeError):
    """An answer did not label every row of its batch with allowed labels."""

    def __init__(self, message: str, violations: list | None = None):
        super().__init__(message)
        self.violations = violations or []


# ---------------------------------------------------------------------------
# batch plan
# ---------------------------------------------------------------------------
def check_batch_size(batch_size: int) -> None:
    if not 1 <= batch_size <= S.MAX_SHORT_ID_BATCH:
        raise ValueError(f"batch size must be within 1..{S.MAX_SHORT_ID_BATCH} (three-digit ids)")


def assign_batches(df: DataFrame, batch_size: int = S.DEFAULT_BATCH_SIZE,
                   order_cols: list | None = None) -> DataFrame:
    """consecutive batches of ``batch_size`` in the given order.

    Adds ``plan_idx`` (0-based global position), ``batch_no`` (1-based),
    ``batch_pos`` (0-based inside the batch) and ``short_id`` ('001'...).  Only the order
    columns are sorted and written; the texts are joined to their positions.
    """
    check_batch_size(batch_size)
    order = order_cols or ["ref_id"]
    indexed = row_positions(df, order, name="plan_idx")
    return (indexed
            .withColumn("batch_no", (F.floor(F.col("plan_idx") / batch_size) + 1).cast("int"))
            .withColumn("batch_pos", F.pmod(F.col("plan_idx"), F.lit(batch_size)).cast("int"))
            .withColumn("short_id", F.lpad((F.col("batch_pos") + 1).cast("string"), 3, "0")))


def batch_plan_summary(plan: DataFrame) -> DataFrame:
    """Rows per batch (the number of batches is the row count of this table)."""
    return plan.groupBy("batch_no").agg(F.count(F.lit(1)).alias("batch_rows"))


# ---------------------------------------------------------------------------
# prompts
# ---------------------------------------------------------------------------
def last_resort(categories: list[str]) -> str:
    """The label for a listing that fits none better.  Fixed rule: Poor if it is offered (or no
    labels are given), else the last one."""
    if not categories or S.CATEGORY_POOR in categories:
        return S.CATEGORY_POOR
    return categories[-1]


@dataclass(frozen=True)
class PromptTemplate:
    """How a batch is put to the scorer: a head, every listing in an ``item`` frame, a tail.

    ``head`` may hold {profile}, {labels} (a line per label with its hint) and {last_resort};
    ``item`` holds {id} and then {text}, once each.  The answer format is not part of it: one
    line ``[id] - label`` per listing, which ``tail`` has to ask for.
    """

    head: str = "# Profile\n{profile}\n\n# Labels, best first\n{labels}If none fits: {last_resort}\n\n# Listings\n"
    item: str = "\n== {id} ==\n{text}\n"
    tail: str = ("\n# Task\nLabel every listing above against the profile. "
                 "One line each, nothing else: [id] - label\n")

    def __post_init__(self):
        if self.item.count("{id}") != 1 or self.item.count("{text}") != 1 or \
                self.item.index("{id}") > self.item.index("{text}"):
            raise ValueError("the item frame needs {id} and then {text}, once each")

    def head_for(self, categories: list[str], profile: str, guidance: dict | None = None) -> str:
        hints = guidance or {}
        labels = "".join(f"- {c}{': ' + hints[c] if c in hints else ''}\n" for c in categories)
        given = {"{profile}": profile.strip(), "{labels}": labels, "{last_resort}": last_resort(categories)}
        return re.sub("|".join(map(re.escape, given)), lambda m: given[m[0]], self.head)

    def frame(self) -> tuple[str, str, str]:
        """What stands before the id, between id and text, and after the text."""
        before, rest = self.item.split("{id}")
        return (before, *rest.split("{text}"))


DEFAULT_TEMPLATE = PromptTemplate()


def _items(plan: DataFrame, text) -> DataFrame:
    """One row per batch: its (pos, short_id, text) in order (at most 999)."""
    return plan.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct(
        F.col("batch_pos").alias("pos"), F.col("short_id").alias("short_id"),
        text.alias("text")))).alias("items"))


def build_batch_prompts(plan: DataFrame, profile: str, categories: list[str] | None = None,
                        guidance: dict | None = None, template: PromptTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """One prompt per batch: head, then each row's id and text in order, then tail."""
    before, between, after = map(F.lit, template.frame())
    body = F.array_join(F.transform("items", lambda x: F.concat(before, x["short_id"], between, x["text"], after)), "")
    return _items(plan, F.coalesce(F.col("text"), F.lit(""))).select(
        "batch_no", F.size("items").alias("n_items"),
        F.concat(F.lit(template.head_for(categories or S.CATEGORIES, profile, guidance)), body,
                 F.lit(template.tail)).alias("prompt"))


# ---------------------------------------------------------------------------
# scorer plug point (2.11)
# ---------------------------------------------------------------------------
@dataclass
class BatchPrompt:
    batch_no: int
    prompt: str
    items: list  # [(short_id, text)] in batch order


# a user's scorer gets batches in a Python worker; one with ``row_label`` stays on the JVM
Scorer = Callable[[list[BatchPrompt]], list[str]]


def terms(text: Column, min_len: int = 4) -> Column:
    """Distinct lower-cased ASCII words of at least ``min_len`` letters."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([A-Za-z]{{{min_len},}})"), 1)
    return F.array_distinct(F.transform(words, F.lower))


@dataclass
class TermOverlapScorer:
    """Deterministic stand-in scorer: share of distinct profile terms found in a text.

    A share >= ``excellent`` gives the first label, >= ``good`` the second, else the label
    of last resort.  It only exists so that the whole path runs offline; it is a column
    expression, so no text leaves the JVM.
    """

    profile: str
    excellent: float = 0.25
    good: float = 0.12
    min_len: int = 4
    categories: list = field(default_factory=lambda: list(S.CATEGORIES))

    def row_label(self, text: Column, batch_no: Column) -> Column:
        wanted = sorted({w.lower() for w in re.findall(f"[A-Za-z]{{{self.min_len},}}", self.profile)})
        worst = F.lit(last_resort(self.categories))
        if not wanted:
            return worst
        found = F.array_intersect(F.array(*[F.lit(w) for w in wanted]), terms(text, self.min_len))
        share = F.size(found) / len(wanted)
        return F.when(share >= self.excellent, self.categories[0]).when(
            share >= self.good, self.categories[1]).otherwise(worst)


@dataclass
class ReplayScorer:
    """Replays recorded answers by batch number (e.g. from a RESPONSE table)."""

    answers: dict
    default: str = ""

    def __call__(self, batches: list[BatchPrompt]) -> list[str]:
        return [self.answers.get(b.batch_no, self.default) for b in batches]


def run_scorer(plan: DataFrame, scorer: Scorer, run_id: str, head: str,
               template: PromptTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """One answer per batch -> RESPONSE rows.

    A scorer with ``row_label(text, batch_no)`` is applied as columns.  Any other is called
    in ``mapInPandas`` with its batches; a text is sent to Python once, inside its batch,
    and the prompt is put together there.
    """
    if hasattr(scorer, "row_label"):
        lines = _items(plan, scorer.row_label(F.col("text"), F.col("batch_no")))
        answer = F.array_join(F.transform("items", lambda x: F.concat(
            F.lit("["), x["short_id"], F.lit("] - "), x["text"])), "\n")
        return lines.select(F.lit(run_id).alias("run_id"), "batch_no", answer.alias("content"),
                            F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias(
                                "message"))).alias("choices"))).alias("raw_json"))
    ship_package(plan.sparkSession)
    before, between, after = template.frame()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            batch = []
            for b, items in zip(pdf["batch_no"], pdf["items"], strict=True):
                own = [(x["short_id"], x["text"]) for x in items]
                body = "".join(before + sid + between + text + after for sid, text in own)
                batch.append(BatchPrompt(int(b), head + body + template.tail, own))
            answers = scorer(batch) if batch else []
            if len(answers) != len(batch):
                raise RuntimeError("the scorer must return one answer per batch")
            yield pd.DataFrame({
                "run_id": [run_id] * len(batch),
                "batch_no": [b.batch_no for b in batch],
                "content": answers,
                "raw_json": [json.dumps({"choices": [{"message": {"content": a}}]}) for a in answers],
            })

    return _items(plan, F.coalesce(F.col("text"), F.lit(""))).mapInPandas(run, S.RESPONSE)


# ---------------------------------------------------------------------------
# Parsing and checks
# ---------------------------------------------------------------------------
_WS = S.PY_WHITESPACE_CLASS
LINE_RE = r"(?s)^\[([0-9]{3})\]" + _WS + r"*-" + _WS + r"*(.+)$"


def _strip(col):
    return F.regexp_replace(col, f"^{_WS}+|{_WS}+$", "")


def parse_lines(responses: DataFrame) -> DataFrame:
    """J3 step 1: every answer line of the form ``[ddd] - a, b`` with its labels."""
    lines = responses.select("run_id", "batch_no",
                             F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n"))
                             .alias("line_no", "raw_line"))
    lines = lines.withColumn("line", _strip(F.col("raw_line")))
    matched = lines.where(F.col("line").rlike(LINE_RE))
    return matched.select(
        "run_id", "batch_no", "line_no",
        F.regexp_extract("line", LINE_RE, 1).alias("short_id"),
        F.transform(F.split(_strip(F.regexp_extract("line", LINE_RE, 2)), ","),
                    lambda c: _strip(c)).alias("labels"),
    )


def invalid_labels(parsed: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Lines with any label outside the allowed set (out-of-range ids included)."""
    allowed = F.array(*[F.lit(c) for c in (categories or S.CATEGORIES)])
    return parsed.where(F.size(F.array_except("labels", allowed)) > 0).select(
        "run_id", "batch_no", "line_no", "short_id",
        F.array_except("labels", allowed).alias("bad_labels"))


def last_labels(parsed: DataFrame) -> DataFrame:
    """J3 step 2: the last line of each id wins."""
    w = Window.partitionBy("run_id", "batch_no", "short_id").orderBy(F.desc("line_no"))
    return (parsed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("run_id", "batch_no", "short_id", F.col("labels").alias("categories")))


def missing_in_batch(plan: DataFrame, labelled: DataFrame) -> DataFrame:
    """H3: plan positions without an answer."""
    return plan.select("batch_no", "short_id", "ref_id").join(
        labelled.select("batch_no", "short_id"), ["batch_no", "short_id"], "left_anti")


def apply_labels(plan: DataFrame, labelled: DataFrame) -> DataFrame:
    """C4: labels -> plan positions -> listings (ids outside the batch never match)."""
    return plan.join(labelled.select("batch_no", "short_id", "categories"),
                     ["batch_no", "short_id"], "inner")


def check_batches(plan: DataFrame, responses: DataFrame, categories: list[str] | None = None,
                  few: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns (labelled plan rows of valid batches, violations per batch).

    ``few``: the plan is known to be small, so the labels go to its rows, not the texts to the labels.
    """
    parsed = parse_lines(responses)
    bad = invalid_labels(parsed, categories).select(
        "batch_no", F.lit("invalid_label").alias("kind"), "short_id",
        F.array_join("bad_labels", ", ").alias("detail"))
    best = last_labels(parsed)
    to_rows = F.broadcast if few else (lambda df: df)
    missing = missing_in_batch(plan, best).select(
        "batch_no", F.lit("missing").alias("kind"), "short_id", F.col("ref_id").alias("detail"))
    violations = bad.unionByName(missing)
    bad_batches = violations.select("batch_no").distinct()
    labelled = apply_labels(plan, to_rows(best)).join(to_rows(bad_batches), "batch_no", "left_anti")
    return labelled, violations


# ---------------------------------------------------------------------------
# End to end
# ---------------------------------------------------------------------------
@dataclass
class ClassifyResult:
    labelled: DataFrame    # plan rows of valid batches + categories
    violations: DataFrame  # (batch_no, kind, short_id, detail)
    responses: DataFrame   # RESPONSE rows (durable)
    plan: DataFrame


def check_listings(df: DataFrame, profile: str) -> None:
    """What labelling needs, whatever rows there are."""
    if not profile or not profile.strip():
        raise ValueError("a profile text is required")
    if "text" not in df.columns or "ref_id" not in df.columns:
        # K21 (changed): rows that never went through extraction are refused
        raise ValueError("labelling needs ref_id and text columns; extract the listings first")


def checked_plan(df: DataFrame, profile: str, batch_size: int = S.DEFAULT_BATCH_SIZE,
                 order_cols: list | None = None, max_chars: int | None = None) -> DataFrame:
    """The batch plan of rows that can be labelled; ``OversizeTextError`` over a given limit."""
    check_listings(df, profile)
    plan = assign_batches(df, batch_size, order_cols)
    if max_chars is not None:
        over = size_guard(plan, max_chars).limit(1).collect()
        if over:
            r = over[0]
            raise OversizeTextError(
                f"listing {r['ref_id']} has {r['length']} characters, over {max_chars} "
                f"({r['loss']} would be lost)")
    return plan


def classify(df: DataFrame, scorer: Scorer, profile: str, run_id: str,
             batch_size: int = S.DEFAULT_BATCH_SIZE, order_cols: list | None = None,
             categories: list[str] | None = None, guidance: dict | None = None,
             max_chars: int | None = None, response_dir: str | None = None,
             template: PromptTemplate = DEFAULT_TEMPLATE) -> ClassifyResult:
    """Label ``df`` (ref_id, text, ...) in batches; nothing is cut or dropped.

    With ``max_chars`` given, ``OversizeTextError`` is raised before any scoring when a text
    is longer (B13).  Answers are written to ``response_dir`` (a folder for this
    attempt only) or checkpointed before they are validated.  ``runs.resume_classify`` asks in
    rounds and keeps every answer in the run's log.
    """
    plan = checked_plan(df, profile, batch_size, order_cols, max_chars)
    head = template.head_for(categories or S.CATEGORIES, profile, guidance)
    responses = run_scorer(plan, scorer, run_id, head, template)
    spark = df.sparkSession
    if response_dir:
        # one folder per attempt: answers of an earlier attempt never mix in
        responses.write.mode("overwrite").parquet(response_dir)
        responses = spark.read.schema(S.RESPONSE).parquet(response_dir)
    else:
        # one job: the scorer is called once per batch (a checkpoint would call it twice)
        responses = materialize(responses, "responses")
    labelled, violations = check_batches(plan, responses, categories)
    return ClassifyResult(labelled=labelled, violations=violations, responses=responses, plan=plan)


def raise_on_violations(result: ClassifyResult, shown: int = 5) -> None:
    """Fail the run if any check failed; the message has the count and the folder of the full table."""
    spark = result.violations.sparkSession
    path = scratch_path(spark, "violations")
    result.violations.write.parquet(path)
    written = spark.read.schema(result.violations.schema).parquet(path)
    n = written.count()
    if n:
        rows = written.orderBy("batch_no", "short_id").limit(shown).collect()
        some = "; ".join(f"batch {r['batch_no']} {r['kind']} [{r['short_id']}] {r['detail']}" for r in rows)
        raise LabelIntegrityError(f"labelling failed: {n} violations, all in {path}; first: {some}",
                                  [r.asDict() for r in rows])
