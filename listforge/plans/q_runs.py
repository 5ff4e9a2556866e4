"""Queries for run state and resume.

Scenario: the classify binding of ``q_labels`` is labelled with a scorer whose
answers for every third batch carry an unknown label, so the first run saves
the other batches and stops; the run is then resumed with the good scorer.
State lives in a fresh folder under the shared checkpoint folder per call.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from listforge.operators import labels as L
from listforge.operators import runs as R
from listforge.plans import q_labels as QL
from listforge.plans.registry import register
from listforge.session import materialize, scratch_path

RUN = "run-resume-q"


@dataclass
class BrokenEveryThird:
    """Wraps a scorer; answers of batches 3, 6, 9 ... use a label outside the set."""

    inner: L.TermOverlapScorer

    def row_label(self, text, batch_no):
        label = self.inner.row_label(text, batch_no)
        return F.when(batch_no % 3 == 0, F.concat(F.lit("Maybe "), label)).otherwise(label)


def interrupted(spark, sf):
    profile = QL.profile_text(spark, sf)
    root = scratch_path(spark, "runs")
    ok = QL.ok_listings(spark, sf)
    R.resume_classify(ok, BrokenEveryThird(L.TermOverlapScorer(profile)), profile, RUN, root, batch_size=QL.BATCH,
                      order_cols=["ref_id"], raise_on_error=False)
    return ok, profile, root


def _plan(spark, sf, ok):
    return L.assign_batches(ok, QL.BATCH, ["ref_id"])


_CLS = QL._classify_sql(0)


@register("read_partial", _CLS.replace(
    "SELECT ref_id, batch_no, short_id,", "SELECT * FROM (SELECT ref_id, batch_no,", 1
) + ") WHERE batch_no % 3 <> 0")
def q_read_partial(spark, sf):
    """What the interrupted run saved (every batch except 3, 6, 9 ...)."""
    _ok, _p, root = interrupted(spark, sf)
    part = R.read_partial(spark, root, RUN)
    return part.select("ref_id", "batch_no", F.array_join("categories", ", ").alias("category"))


@register("remaining", QL._PLAN_SQL + """
SELECT ref_id FROM plan2 WHERE batch_no % 3 = 0""")
def q_remaining(spark, sf):
    """Rows of the interrupted run still to label."""
    ok, _p, root = interrupted(spark, sf)
    return R.remaining(ok, R.read_partial(spark, root, RUN).select("ref_id")).select("ref_id")


@register("pending", QL._PLAN_SQL + """
SELECT ref_id, batch_no FROM plan2 WHERE batch_no % 3 = 0""")
def q_pending(spark, sf):
    """H4: plan positions minus completed refs."""
    ok, _p, root = interrupted(spark, sf)
    return R.pending(_plan(spark, sf, ok), R.read_partial(spark, root, RUN)).select(
        "ref_id", "batch_no")


@register("progress", QL._PLAN_SQL + """,
pb AS (SELECT batch_no, count(*) AS n, count_if(batch_no % 3 <> 0) AS d FROM plan2 GROUP BY batch_no)
SELECT CAST(sum(d) AS BIGINT) AS completed, CAST(sum(n) - sum(d) AS BIGINT) AS pending,
       CAST(count_if(d = n) AS BIGINT) AS batches_done, CAST(count(*) AS BIGINT) AS total_batches
FROM pb""")
def q_progress(spark, sf):
    """progress of the interrupted run."""
    ok, _p, root = interrupted(spark, sf)
    return R.progress(_plan(spark, sf, ok), R.read_partial(spark, root, RUN))


@register("resume_classify", _CLS.replace("SELECT ref_id, batch_no, short_id,", "SELECT ref_id,", 1))
def q_resume_classify(spark, sf):
    """Resume the interrupted run; the result equals an uninterrupted run."""
    ok, profile, root = interrupted(spark, sf)
    out = R.resume_classify(ok, L.TermOverlapScorer(profile), profile, RUN, root,
                            batch_size=QL.BATCH, order_cols=["ref_id"])
    return out.select("ref_id", F.array_join("categories", ", ").alias("category"))


@register("resumed_result", _CLS.replace(
    "SELECT ref_id, batch_no, short_id,",
    "SELECT ref_id, CASE WHEN batch_no % 3 = 0 THEN 'new' ELSE 'resumed' END AS part,", 1))
def q_resumed_result(spark, sf):
    """H2: resumed partial rows plus the newly labelled ones, each marked."""
    ok, profile, root = interrupted(spark, sf)
    before = materialize(R.read_partial(spark, root, RUN).select("ref_id", "batch_no", "categories"), "before")
    R.resume_classify(ok, L.TermOverlapScorer(profile), profile, RUN, root,
                      batch_size=QL.BATCH, order_cols=["ref_id"])
    fresh = R.read_partial(spark, root, RUN).join(before.select("batch_no").distinct(), "batch_no", "left_anti")
    out = R.resumed_result(before, fresh)
    return out.select("ref_id", "part", F.array_join("categories", ", ").alias("category"))


@register("reclassify_store", QL._classify_sql(1).replace(
    "SELECT ref_id, batch_no, short_id,", "SELECT ref_id,", 1))
def q_reclassify_store(spark, sf):
    """All stored listings with text, labelled against another profile (item 1)."""
    from listforge.plans import bindings as B
    from listforge.plans.q_store import doc_store

    profile = QL.profile_text(spark, sf, 1)
    out = R.reclassify_store(doc_store(spark, sf), L.TermOverlapScorer(profile), profile, "reclassify-q",
                             scratch_path(spark, "runs"), B.INTERNAL_BASE_URL,
                             batch_size=QL.BATCH, order_cols=["ref_id"])
    return out.select("ref_id", F.array_join("categories", ", ").alias("category"))


def _labelled_plan(spark, sf):
    profile = QL.profile_text(spark, sf)
    res = L.classify(QL.ok_listings(spark, sf), L.TermOverlapScorer(profile), profile, RUN,
                     batch_size=QL.BATCH, order_cols=["ref_id"])
    return res.labelled


@register("append_partial", _CLS.replace("SELECT ref_id, batch_no, short_id,",
                                         "SELECT ref_id, batch_no,", 1))
def q_append_partial(spark, sf):
    """Finished batches appended in two steps (odd, then even batches), read back."""
    lab = _labelled_plan(spark, sf)
    root = scratch_path(spark, "runs")
    R.append_partial(root, RUN, lab.where(F.col("batch_no") % 2 == 1))
    R.append_partial(root, RUN, lab.where(F.col("batch_no") % 2 == 0))
    return R.read_partial(spark, root, RUN).select(
        "ref_id", "batch_no", F.array_join("categories", ", ").alias("category"))


@register("clear_run", _CLS.replace(
    "SELECT ref_id, batch_no, short_id,", "SELECT * FROM (SELECT ref_id, batch_no,", 1
) + ") WHERE batch_no > 3")
def q_clear_run(spark, sf):
    """Batches 1-3 saved, the run cleared, the later batches saved: only those remain."""
    lab = _labelled_plan(spark, sf)
    root = scratch_path(spark, "runs")
    R.append_partial(root, RUN, lab.where(F.col("batch_no") <= 3))
    R.clear_run(spark, root, RUN)
    R.append_partial(root, RUN, lab.where(F.col("batch_no") > 3))
    return R.read_partial(spark, root, RUN).select(
        "ref_id", "batch_no", F.array_join("categories", ", ").alias("category"))
