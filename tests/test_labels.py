"""Labelling integrity: every violation fails its batch and nothing of it is kept."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from listforge import schemas as S
from listforge.operators import filters as FL
from listforge.operators import indexing as IX
from listforge.operators import labels as L
from listforge.operators import runs as R

PROFILE = "python spark data engineering pipelines"


def listings(spark, n=6, text="some text"):
    rows = [(f"ref{i:02d}", f"title {i}", text) for i in range(n)]
    return spark.createDataFrame(rows, "ref_id string, title string, text string")


def run(spark, answers, n=6, size=2):
    res = L.classify(listings(spark, n), L.ReplayScorer(answers), PROFILE, "t", batch_size=size)
    lab = {r["ref_id"]: r["categories"] for r in res.labelled.collect()}
    bad = {(r["batch_no"], r["kind"]) for r in res.violations.collect()}
    return lab, bad


GOOD = "[001] - Good Match\n[002] - Poor Match"


def test_all_valid(spark):
    lab, bad = run(spark, {1: GOOD, 2: GOOD, 3: GOOD})
    assert not bad and len(lab) == 6 and lab["ref00"] == ["Good Match"]


@pytest.mark.parametrize("answer,kind", [
    ("[001] - Good Match", "missing"),                       # missing id
    ("[001] - Good Match\n[002] - Great Match", "invalid_label"),   # unknown label
    ("[001] - Good Match,\n[002] - Poor Match", "invalid_label"),   # trailing comma
    ("[001] - Good Match\n[002] - Poor Match\n[005] - Maybe", "invalid_label"),  # out of range
])
def test_violations_fail_only_their_batch(spark, answer, kind):
    lab, bad = run(spark, {1: GOOD, 2: answer, 3: GOOD})
    assert (2, kind) in bad
    assert set(lab) == {"ref00", "ref01", "ref04", "ref05"}


def test_last_line_wins_and_out_of_range_valid_is_ignored(spark):
    ans = "noise\n  [001]-Poor Match  \n[002] - Poor Match\n[001] - Excellent Match, Good Match\n" \
          "[009] - Good Match"
    lab, bad = run(spark, {1: ans, 2: GOOD, 3: GOOD})
    assert not bad
    assert lab["ref00"] == ["Excellent Match", "Good Match"]


def test_oversize_text_fails_before_scoring(spark):
    df = spark.createDataFrame([("big", "x" * (S.MAX_TEXT_CHARS + 1))], "ref_id string, text string")
    with pytest.raises(FL.OversizeTextError):
        L.classify(df, L.ReplayScorer({}), PROFILE, "t", max_chars=S.MAX_TEXT_CHARS)
    long_ok = L.classify(df, L.ReplayScorer({1: "[001] - Good Match"}), PROFILE, "t")
    assert long_ok.labelled.count() == 1  # no limit unless one is given
    ok = spark.createDataFrame([("fits", "x" * S.MAX_TEXT_CHARS)], "ref_id string, text string")
    assert FL.size_guard(ok).count() == 0


def test_batch_size_bounds(spark):
    with pytest.raises(ValueError):
        L.assign_batches(listings(spark), 1000)
    plan = L.assign_batches(listings(spark, 7), 3).orderBy("plan_idx").collect()
    assert [r["batch_no"] for r in plan] == [1, 1, 1, 2, 2, 2, 3]
    assert [r["short_id"] for r in plan][:4] == ["001", "002", "003", "001"]


def test_global_index_equals_row_number(spark):
    from pyspark.sql import Window

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source")
    got = IX.global_index(docs, ["source", "doc_id"], "idx", num_partitions=5)
    want = docs.withColumn("idx", F.row_number().over(Window.orderBy("source", "doc_id")) - 1)
    assert sorted(map(tuple, got.select("doc_id", "idx").collect())) == \
        sorted(map(tuple, want.select("doc_id", F.col("idx").cast("long")).collect()))


def test_prompt_layout(spark):
    plan = L.assign_batches(listings(spark, 3, "hello"), 2)
    prompts = {r["batch_no"]: r["prompt"] for r in L.build_batch_prompts(plan, PROFILE).collect()}
    head = L.DEFAULT_TEMPLATE.head_for(S.CATEGORIES, PROFILE)
    assert prompts[1] == head + "\n== 001 ==\nhello\n\n== 002 ==\nhello\n" + L.DEFAULT_TEMPLATE.tail
    seen = L.run_scorer(plan, lambda batches: [b.prompt for b in batches], "r", head)
    assert {r["batch_no"]: r["content"] for r in seen.collect()} == prompts


def test_own_prompt_template(spark):
    own = L.PromptTemplate(head="{last_resort}|{labels}|{profile}|{text}", item="<{id}:{text}>", tail="!")
    plan = L.assign_batches(listings(spark, 3, "{id} {profile}"), 2)
    want = {1: "B|- A: best\n- B\n|me {labels}|{text}<001:{id} {profile}><002:{id} {profile}>!",
            2: "B|- A: best\n- B\n|me {labels}|{text}<001:{id} {profile}>!"}
    args = (["A", "B"], " me {labels} ", {"A": "best"})
    prompts = L.build_batch_prompts(plan, args[1], args[0], args[2], own)
    assert {r["batch_no"]: r["prompt"] for r in prompts.collect()} == want
    seen = L.run_scorer(plan, lambda batches: [b.prompt for b in batches], "r", own.head_for(*args), own)
    assert {r["batch_no"]: r["content"] for r in seen.collect()} == want
    for bad in ("{text}", "{id}", "{text} {id}", "{id} {text} {text}"):
        with pytest.raises(ValueError):
            L.PromptTemplate(item=bad)


def test_row_positions_number_repeated_keys(spark):
    df = spark.createDataFrame([(k, v) for k, v in [("b", 1), ("a", 1), ("b", 2), (None, 1), ("c", 1), ("b", 3)]],
                               "k string, v int")
    got = sorted((r["idx"], r["k"]) for r in IX.row_positions(df, ["k"], "idx").collect())
    assert got == [(0, None), (1, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "c")]


def test_violations_name_their_true_count(spark):
    res = L.classify(listings(spark, 40), L.ReplayScorer({}), PROFILE, "t", batch_size=4)
    with pytest.raises(L.LabelIntegrityError, match="40 violations, all in "):
        L.raise_on_violations(res)


def test_last_resort():
    assert L.last_resort(S.CATEGORIES) == "Poor Match"
    assert L.last_resort(["Poor Match", "x"]) == "Poor Match" and L.last_resort(["x", "y"]) == "y"


def test_scorer_is_deterministic(spark):
    sc = L.TermOverlapScorer("alpha beta gamma delta")
    rows = spark.createDataFrame([("Alpha beta and more",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in rows.select(sc.row_label(F.col("t"), F.lit(1))).collect()]
    assert got == ["Excellent Match", "Poor Match", "Poor Match"]


def test_resume_equals_uninterrupted(spark, scratch):
    from listforge.plans.q_runs import BrokenEveryThird

    df = listings(spark, 20, "python spark")
    good = L.TermOverlapScorer(PROFILE)
    with pytest.raises(L.LabelIntegrityError):
        R.resume_classify(df, BrokenEveryThird(good), PROFILE, "r1", scratch, batch_size=3)
    saved = R.read_partial(spark, scratch, "r1")
    assert saved.count() == 20 - 3 - 3  # batches 3 and 6 failed (3 rows each)
    prog = R.progress(L.assign_batches(df, 3), saved).collect()[0]
    assert (prog["completed"], prog["pending"], prog["total_batches"]) == (14, 6, 7)
    out = R.resume_classify(df, good, PROFILE, "r1", scratch, batch_size=3)
    whole = L.classify(df, good, PROFILE, "x", batch_size=3).labelled
    assert sorted((r["ref_id"], tuple(r["categories"])) for r in out.collect()) == \
        sorted((r["ref_id"], tuple(r["categories"])) for r in whole.collect())
    fresh = R.resume_classify(df, good, PROFILE, "r1", scratch, batch_size=3, resume=False)
    assert fresh.count() == 20


def test_labelling_refuses_rows_without_text(spark):
    raw = spark.createDataFrame([("r1", "title")], "ref_id string, title string")
    with pytest.raises(ValueError, match="extract"):
        L.classify(raw, L.ReplayScorer({}), PROFILE, "t")
    with pytest.raises(ValueError, match="profile"):
        L.classify(listings(spark), L.ReplayScorer({}), "  ", "t")


def counted(folder, stop_at=10 ** 9, bad=()):
    """A scorer that answers with one label and leaves a file per call; batches in ``bad`` get no
    label, and a batch from ``stop_at`` on ends the run.  (A local function: workers get its code.)"""
    def score(batches):
        import uuid

        out = []
        for b in batches:
            if b.batch_no >= stop_at:
                raise RuntimeError("the provider is gone")
            with open(f"{folder}/{b.batch_no}-{uuid.uuid4().hex}", "w"):
                pass
            out.append("" if b.batch_no in bad else "\n".join(f"[{i}] - Good Match" for i, _ in b.items))
        return out

    return score


def calls(folder):
    return Counter(int(n.split("-")[0]) for n in os.listdir(folder))


def test_a_run_that_ends_is_never_asked_again_for_an_answer_it_has(spark, scratch):
    folder = scratch + "/calls"
    os.mkdir(folder)
    df = listings(spark, 20, "x")  # batches 1..10 in rounds of 3
    with pytest.raises(Exception, match="provider is gone"):
        R.resume_classify(df, counted(folder, stop_at=7), PROFILE, "r", scratch, batch_size=2, round_batches=3)
    assert calls(folder) == {b: 1 for b in range(1, 7)}
    assert R.read_partial(spark, scratch, "r").count() == 12  # saved round by round
    out = R.resume_classify(df, counted(folder), PROFILE, "r", scratch, batch_size=2, round_batches=3)
    assert calls(folder) == {b: 1 for b in range(1, 11)}
    assert sorted(r["ref_id"] for r in out.collect()) == sorted(r["ref_id"] for r in df.collect())
    again = R.resume_classify(df, counted(folder), PROFILE, "r", scratch, batch_size=2, round_batches=3)
    assert again.count() == 20 and sum(calls(folder).values()) == 10


def test_logged_answers_are_checked_without_asking_again(spark, scratch):
    """The driver goes between the answers and their check: the next call reads them from the log."""
    folder = scratch + "/calls"
    os.mkdir(folder)
    df = listings(spark, 8, "x")
    kept, R.append_partial = R.append_partial, lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost"))
    try:
        with pytest.raises(RuntimeError, match="driver lost"):
            R.resume_classify(df, counted(folder, bad=[2]), PROFILE, "r", scratch, batch_size=2)
    finally:
        R.append_partial = kept
    with pytest.raises(L.LabelIntegrityError):  # the log's batch 2 is still wrong
        R.resume_classify(df, counted(folder), PROFILE, "r", scratch, batch_size=2)
    assert calls(folder) == {1: 1, 2: 1, 3: 1, 4: 1}
    out = R.resume_classify(df, counted(folder), PROFILE, "r", scratch, batch_size=2)
    assert calls(folder) == {1: 1, 2: 2, 3: 1, 4: 1} and out.count() == 8


def test_new_rows_join_a_run_in_new_batches(spark, scratch):
    folder = scratch + "/calls"
    os.mkdir(folder)
    R.resume_classify(listings(spark, 5, "x"), counted(folder), PROFILE, "r", scratch, batch_size=2)
    out = R.resume_classify(listings(spark, 9, "x"), counted(folder), PROFILE, "r", scratch, batch_size=2)
    assert out.groupBy("ref_id").count().where("count > 1").isEmpty() and out.count() == 9
    assert calls(folder) == {b: 1 for b in range(1, 6)}


def test_resumed_run_moves_no_text_without_new_rows(spark, scratch):
    """A call without new refs plans nothing; later refs go on after the known batches; ties and null refs count."""
    rows = [(f"r{i:02d}", "t", "c", "e", f"text {i}", "u") for i in range(7)] + [(None, "t", "c", "e", "null ref", "u")]
    df = spark.createDataFrame(rows, "ref_id string, title string, city string, employer string, text string, url string")
    good = L.TermOverlapScorer("text profile words")
    R.resume_classify(df, good, "text profile words", "r9", scratch, batch_size=3)
    again = R.resume_classify(df, good, "text profile words", "r9", scratch, batch_size=3)
    plans = spark.read.parquet(f"{scratch}/plans/run_id=r9")
    assert again.count() == 8 and {r["part"] for r in plans.select("part").distinct().collect()} == {1}
    more = df.unionByName(spark.createDataFrame([("s1", "t", "c", "e", "new", "u"), ("s1", "t", "c", "e", "new", "u")], df.schema))
    out = R.resume_classify(more, good, "text profile words", "r9", scratch, batch_size=3)
    got = sorted((r["ref_id"] or "", r["batch_no"]) for r in out.collect())
    assert len(got) == 10 and [x for x in got if x[0] == "s1"] == [("s1", 4), ("s1", 4)]


def test_positions_shuffle_wide_rows_once(spark):
    """Join and window of the positions go by one column; equal and null keys get positions of their own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.createDataFrame([("b", "1"), (None, "2"), ("a", "3"), ("a", "3"), ("a", "4")], "ref_id string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.assign_batches(df, 2, ["ref_id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning(_key" in line for line in plan.splitlines()) == 2
        rows = out.orderBy("plan_idx").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r["plan_idx"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["ref_id"] for r in rows] == [None, "a", "a", "a", "b"]
