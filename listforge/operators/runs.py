"""Run state: partial results, progress, resume.

Layout under a run root (a folder in the shared file system):
    plans/run_id=<id>/part=<n>/          batches as they were cut, by round; kept for the whole run
    answers/run_id=<id>/attempt=<t>/     the answer log: raw answers, a folder per round
    rejected/run_id=<id>/attempt=<t>/    batches whose logged answer failed its checks
    partials/run_id=<id>/attempt=<t>/    labelled rows of finished batches, a folder per append
    runs/                                one row per run event (started / complete)
Every finished batch is recorded (K11: also for single-batch runs) and the run
is marked complete at the end instead of deleting its state.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listforge import schemas as S
from listforge.functions import columns as C
from listforge.operators import labels as L
from listforge.session import materialize
from listforge.sources.store_io import _fs

PARTIAL_SCHEMA = T.StructType([
    T.StructField("ref_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("employer", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("run_id", T.StringType()),
    T.StructField("batch_no", T.IntegerType()),
])
RUN_EVENTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("batches_done", T.LongType()),
    T.StructField("at", T.TimestampType()),
])


def _path(root: str, part: str) -> str:
    return f"{root.rstrip('/')}/{part}"


def append_partial(root: str, run_id: str, labelled: DataFrame) -> None:
    """Append finished batches, one folder per append (``batch_no`` is a column)."""
    cols = [f.name for f in PARTIAL_SCHEMA.fields if f.name not in ("run_id",)]
    out = labelled.select(*[F.col(c) if c in labelled.columns else F.lit(None).cast(
        PARTIAL_SCHEMA[c].dataType).alias(c) for c in cols])
    attempt = f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}"
    out.write.mode("overwrite").parquet(f"{_path(root, 'partials')}/run_id={run_id}/attempt={attempt}")


def read_partial(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Everything labelled so far in this run."""
    fs, jpath, _ = _fs(spark, f"{_path(root, 'partials')}/run_id={run_id}")
    if not fs.exists(jpath):
        return spark.createDataFrame([], PARTIAL_SCHEMA)
    own = T.StructType([f for f in PARTIAL_SCHEMA.fields if f.name != "run_id"])
    rows = spark.read.schema(own).option("recursiveFileLookup", "true").parquet(jpath.toString())
    return rows.withColumn("run_id", F.lit(run_id)).select(*PARTIAL_SCHEMA.fieldNames())


def clear_run(spark: SparkSession, root: str, run_id: str) -> None:
    """Drop a run's partial results and answers (fresh start)."""
    for part in ("partials", "plans", "answers", "rejected"):
        fs, jpath, _ = _fs(spark, f"{_path(root, part)}/run_id={run_id}")
        if fs.exists(jpath):
            fs.delete(jpath, True)


def record_event(spark: SparkSession, root: str, run_id: str, event: str, batches_done: int) -> None:
    row = [(run_id, event, int(batches_done), datetime.now(timezone.utc).replace(tzinfo=None))]
    spark.createDataFrame(row, RUN_EVENTS).coalesce(1).write.mode("append").parquet(
        _path(root, "runs"))


def remaining(df: DataFrame, completed: DataFrame) -> DataFrame:
    """Rows not yet labelled: ref (null -> '') not among the completed refs."""
    done = completed.select(F.coalesce(F.col("ref_id"), F.lit("")).alias("_done_ref")).distinct()
    return (df.withColumn("_ref_key", F.coalesce(F.col("ref_id"), F.lit("")))
            .join(done, F.col("_ref_key") == F.col("_done_ref"), "left_anti").drop("_ref_key"))


def pending(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """H4: plan rows minus completed refs."""
    return remaining(plan, completed)


def progress(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """completed / pending counts and batches done out of the total (one row)."""
    done_refs = completed.select(F.coalesce("ref_id", F.lit("")).alias("_r")).distinct() \
        .withColumn("_done", F.lit(True))
    marked = plan.withColumn("_r", F.coalesce("ref_id", F.lit(""))).join(done_refs, "_r", "left")
    per_batch = marked.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_done").isNotNull()).alias("_d"))
    return per_batch.agg(
        F.sum("_d").cast("long").alias("completed"),
        (F.sum("_n") - F.sum("_d")).cast("long").alias("pending"),
        F.count_if(F.col("_d") == F.col("_n")).cast("long").alias("batches_done"),
        F.count(F.lit(1)).cast("long").alias("total_batches"),
    )


def resumed_result(partials: DataFrame, fresh: DataFrame) -> DataFrame:
    """H2: resumed partial rows followed by newly labelled rows."""
    cols = ["ref_id", "categories"]
    return (partials.select(*cols, F.lit("resumed").alias("part"))
            .unionByName(fresh.select(*cols, F.lit("new").alias("part"))))


_PLAN = T.StructType([*[f for f in PARTIAL_SCHEMA.fields if f.name not in ("run_id", "categories")],
                      T.StructField("batch_pos", T.IntegerType()), T.StructField("short_id", T.StringType()),
                      T.StructField("part", T.IntegerType()), T.StructField("round", T.IntegerType())])
_ANSWERS = T.StructType([*S.RESPONSE.fields, T.StructField("attempt", T.LongType())])
_REJECTED = T.StructType([T.StructField("batch_no", T.IntegerType()), T.StructField("attempt", T.LongType())])
ROUND_BATCHES = 2000   # batches that are asked for, logged and checked in one round
BROADCAST_ROWS = 200_000  # labels of a round with more rows are joined by a shuffle


def _logged(spark: SparkSession, root: str, table: str, run_id: str, schema: T.StructType) -> DataFrame:
    """A table of the run, empty before its first write."""
    fs, jpath, _ = _fs(spark, f"{_path(root, table)}/run_id={run_id}")
    if not fs.exists(jpath):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if table != "plans":  # plans are pruned by their folders
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(jpath.toString())


def plan_run(df: DataFrame, profile: str, run_id: str, root: str, batch_size: int, order_cols: list | None,
             max_chars: int | None, round_batches: int) -> int:
    """Cut rows that the run does not know yet into batches and write them; the run's number of batches.

    Batches keep their numbers for the whole run; later rows go on after them.
    """
    spark = df.sparkSession
    known = _logged(spark, root, "plans", run_id, _PLAN)
    last = known.agg(F.coalesce(F.max("batch_no"), F.lit(0)).alias("b"), F.coalesce(F.max("part"), F.lit(0)).alias("p")).first()
    if last["p"]:  # the refs decide, before any text is moved
        L.check_listings(df, profile)
        L.check_batch_size(batch_size)
        fresh = materialize(remaining(df.select("ref_id").distinct(), known.select("ref_id")), "fresh-refs")
        if fresh.isEmpty():
            return last["b"]
        df = df.join(fresh.select(F.col("ref_id").alias("_fresh")), F.col("ref_id").eqNullSafe(F.col("_fresh")), "left_semi")
    new = L.checked_plan(df, profile, batch_size, order_cols, max_chars)
    batch = (F.col("batch_no") + F.lit(last["b"])).cast("int")
    rows = new.withColumn("batch_no", batch).withColumn("round", F.floor((batch - 1) / round_batches).cast("int"))
    rows = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in _PLAN.fields if f.name != "part"])
    part = f"{_path(root, 'plans')}/run_id={run_id}/part={last['p'] + 1}"
    rows.hint("rebalance", F.col("round")).write.mode("overwrite").partitionBy("round").parquet(part)
    return _logged(spark, root, "plans", run_id, _PLAN).agg(F.coalesce(F.max("batch_no"), F.lit(0)).alias("b")).first()["b"]


def resume_classify(df: DataFrame, scorer: L.Scorer, profile: str, run_id: str, root: str,
                    resume: bool = True, batch_size: int = S.DEFAULT_BATCH_SIZE,
                    order_cols: list | None = None, return_only_matches: bool = False,
                    raise_on_error: bool = True, categories: list[str] | None = None,
                    guidance: dict | None = None, max_chars: int | None = None,
                    template: L.PromptTemplate = L.DEFAULT_TEMPLATE, round_batches: int = ROUND_BATCHES) -> DataFrame:
    """Label what is not yet labelled in ``run_id`` and return all labels of the run.

    Batches are cut once per run and asked for in rounds.  A round asks only for batches
    without a usable answer in the run's log, logs the new answers in one commit, checks what
    the log has and saves the valid batches.  So a run that ends anywhere loses at most the
    answers of its last round, and an answer in the log is never asked for again.  If a batch
    fails its checks, its answer is marked as rejected, the run goes on, and
    ``LabelIntegrityError`` is raised after the last round; a later call asks for those again.
    """
    spark = df.sparkSession
    if not resume:
        clear_run(spark, root, run_id)
    batches = plan_run(df, profile, run_id, root, batch_size, order_cols, max_chars, round_batches)
    head = template.head_for(categories or S.CATEGORIES, profile, guidance)
    # numbers grow with every call: an answer is named by batch and attempt
    attempt = time.time_ns() // 1000
    bad = []
    plans = _logged(spark, root, "plans", run_id, _PLAN)
    for r in [x["round"] for x in plans.select("round").distinct().orderBy("round").collect()]:  # batches / round_batches
        plan = plans.where(F.col("round") == r)
        done = read_partial(spark, root, run_id).select("batch_no")
        # numbers of one round's batches: the texts of its plan stay where they are
        numbers = F.broadcast(materialize(plan.select("batch_no").distinct().join(done, "batch_no", "left_anti"), "round-batches"))
        todo = plan.join(numbers, "batch_no", "left_semi")
        n = todo.count()
        if not n:
            continue
        usable = _logged(spark, root, "answers", run_id, _ANSWERS).join(numbers, "batch_no", "left_semi").join(
            _logged(spark, root, "rejected", run_id, _REJECTED), ["batch_no", "attempt"], "left_anti")
        asked = todo.join(F.broadcast(usable.select("batch_no").distinct()), "batch_no", "left_anti")
        new = L.run_scorer(asked, scorer, run_id, head, template).withColumn("attempt", F.lit(attempt))
        new.write.mode("overwrite").parquet(f"{_path(root, 'answers')}/run_id={run_id}/attempt={attempt}/round={r}")
        answers = _logged(spark, root, "answers", run_id, _ANSWERS).join(numbers, "batch_no", "left_semi").join(
            _logged(spark, root, "rejected", run_id, _REJECTED), ["batch_no", "attempt"], "left_anti")
        labelled, violations = L.check_batches(todo, answers.drop("attempt"), categories, few=n <= BROADCAST_ROWS)
        violations = materialize(violations, "violations")
        append_partial(root, run_id, labelled.drop("run_id"))
        answers.select("batch_no", "attempt").join(violations.select("batch_no").distinct(), "batch_no", "left_semi").write.mode(
            "overwrite").parquet(f"{_path(root, 'rejected')}/run_id={run_id}/attempt={attempt}/round={r}")
        bad.append(violations)
    bad = [v for v in bad if not v.isEmpty()]
    record_event(spark, root, run_id, "failed" if bad else "complete", batches)
    if bad and raise_on_error:
        violations = bad[0]
        for v in bad[1:]:
            violations = violations.unionByName(v)
        L.raise_on_violations(L.ClassifyResult(labelled=None, violations=violations, responses=None, plan=None))
    out = read_partial(spark, root, run_id)
    if return_only_matches:
        out = out.where(C.is_match("categories"))
    return out


def reclassify_store(store: DataFrame, scorer: L.Scorer, profile: str, run_id: str, root: str,
                     internal_base_url: str, **kwargs) -> DataFrame:
    """Label every stored listing with a successful extraction; the store is not written."""
    from listforge.operators.extract import split_outcomes

    ok, _failed = split_outcomes(store, internal_base_url)
    return resume_classify(ok, scorer, profile, run_id, root, **kwargs)
