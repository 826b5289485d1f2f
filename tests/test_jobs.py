"""Job states as a table and as a stream, slots, results, and the stages of grading."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.plans import grade, queries
from lumora.plans.stages import Stages
from lumora.sources import files, slots
from lumora.streaming import jobs

NEXT = {"idle": {"idle", "processing", "error"}, "processing": {"processing", "done", "error"}, "done": set(), "error": set()}


def folded(rows):
    """Last status, step and message of each job, and how many changes counted and how many did not: one change after the other."""
    out = {}
    low = lambda v: (v is not None, v if v is not None else 0)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (low(r[1]), low(r[2]), r[4])):
        status, step, message, taken, ignored = out.get(r[0], ("idle", None, None, 0, 0))
        out[r[0]] = (r[4], r[2], r[5], taken + 1, ignored) if r[4] in NEXT[status] else (status, step, message, taken, ignored + 1)
    return out


def shown(df):
    return {r.job_id: (r.status, r.step, r.message, r.changes, r.ignored) for r in df.collect()}


def some_changes():
    rng = np.random.default_rng(3)
    kinds = ["idle", "processing", "processing", "done", "error", "lost"]
    start = dt.datetime(2024, 1, 1)
    rows = [(f"j{int(rng.integers(60))}", start + dt.timedelta(minutes=int(rng.integers(500))), i % 9, 8, str(rng.choice(kinds)), f"m{i}") for i in range(400)]
    return [*rows, (None, start, 1, 2, "done", "x"), ("k", None, None, None, "processing", None), ("k", start, 4, 4, "done", "y"), ("only-done", start, 1, 1, "done", "z")]


def test_states_of_a_table(spark):
    rows = some_changes()
    df = spark.createDataFrame(rows, jobs.CHANGES).withColumn("no", F.lit("clash"))
    got = files.job_states(df)
    assert shown(got) == folded(rows)
    percent = {r.job_id: r.percent for r in got.collect()}
    assert percent["k"] == 100.0 and percent["only-done"] == 0.0
    assert files.job_states(df.limit(0)).collect() == []


def arrive(folder, name, rows):
    keys = ["job_id", "at", "step", "total", "status", "message"]
    (folder / name).write_text("\n".join(json.dumps({k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in zip(keys, r, strict=True)}) for r in rows))


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """Files of later and later changes, the query stopped and started between them: as the fold over the whole table."""
    source, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    source.mkdir()
    low = dt.datetime(1970, 1, 1)
    rows = sorted((r for r in some_changes() if r[0] != "k"), key=lambda r: (r[1] or low, r[2] or 0))
    # all changes of one time arrive together
    cuts = [0, 120, 250, len(rows)]
    for i, at in enumerate(cuts[1:-1], 1):
        while rows[at][1] == rows[at - 1][1]:
            at += 1
        cuts[i] = at
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        arrive(source, f"{i}.json", rows[a:b])
        jobs.keep_states(jobs.changes(spark, str(source)), store, check, once=True, every=2).awaitTermination()
        assert shown(jobs.progress(spark, store)) == folded(rows[:b])
    # a job that is not known is idle; late news of one that is known change nothing but the count
    assert jobs.progress(spark, store, "nobody").first().status == "idle"
    job, was = next((k, v) for k, v in sorted(folded(rows).items()) if v[0] == "processing")
    arrive(source, "late.json", [(job, dt.datetime(2023, 1, 1), 1, 8, "done", "late")])
    jobs.keep_states(jobs.changes(spark, str(source)), store, check, once=True, every=2).awaitTermination()
    assert shown(jobs.progress(spark, store, job)) == {job: (*was[:4], was[4] + 1)}


def test_silent_jobs_time_out(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for name, rows in (("a", [("slow", at(0), 1, 4, "processing", "a"), ("fine", at(0), 1, 4, "processing", "a"), ("over", at(0), 4, 4, "processing", "b"), ("over", at(1), 4, 4, "done", "b")]), ("b", [("fine", at(50), 2, 4, "processing", "c")]), ("c", [("fine", at(51), 3, 4, "processing", "d")])):
        arrive(source, f"{name}.json", rows)
        jobs.keep_states(jobs.changes(spark, str(source)), store, str(tmp_path / "check"), once=True, timeout_ms=1_800_000, late_ms=60_000).awaitTermination()
    got = {r.job_id: (r.status, r.message, r.percent) for r in jobs.progress(spark, store).collect()}
    assert got == {"slow": ("error", "timed out", 25.0), "fine": ("processing", "d", 75.0), "over": ("done", "b", 100.0)}


def test_slots_hold_one_row_a_key(spark, tmp_path):
    store, want = str(tmp_path / "s"), {}
    assert slots.current(spark, store, "k") is None
    for no in range(11):
        rows = [(i, no, f"{no}-{i}") for i in range(no % 4, 20, 3)]
        want.update({i: v for i, _, v in rows})
        df = spark.createDataFrame(rows, "k int, at int, v string")
        for _ in range(1 + (no == 7)):  # one batch twice, as after a failure
            slots.put(df, store, "k", no, every=3)
        assert {r.k: r.v for r in slots.current(spark, store, "k").collect()} == want
    assert len(list((tmp_path / "s" / "batches").iterdir())) < 8 and len(list((tmp_path / "s" / "snapshots").iterdir())) == 2
    twice = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "k int, at int, v string")
    slots.put(twice, store, "k", 11)
    assert {r.k: r.v for r in slots.current(spark, store, "k").collect()}[1] == "new"


def test_results_have_a_slot_for_each_exam(spark, tmp_path):
    store = str(tmp_path / "r")
    assert jobs.results(spark, store) is None
    jobs.keep_results(spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], "exam_id int, student_id int, total_score double"), store, 0, "2024-01-01")
    jobs.keep_results(spark.createDataFrame([(1, 1, 9.0)], "exam_id int, student_id int, total_score double"), store, 1, "2024-01-02")
    assert {(r.exam_id, r.student_id, r.total_score) for r in jobs.results(spark, store).collect()} == {(1, 1, 9.0), (2, 1, 7.0)}
    assert [r.total_score for r in jobs.results(spark, store, 2).collect()] == [7.0]


def test_stages_count_what_the_tables_hold(spark):
    tables = queries._grade_tables(spark, "/root/testdata/sf0.001")
    models, students, rubric, exams = tables
    rows, totals, stages = grade.timed_grade(*tables)
    got = {r.stage: r for r in stages.collect()}
    assert got["models"].rows == models.count() and got["students"].rows == students.count() and got["exams"].rows == exams.count()
    assert got["students"].errors == students.where("trim(text) = ''").count()
    assert got["breakdown"].rows == rows.count() == got["scores"].rows and got["results"].rows == totals.count()
    assert got["scores"].errors == rows.where("feedback like 'Not Attempted%'").count()
    assert all(r.seconds >= 0 and r.status == "done" for r in got.values()) and got["total"].seconds >= max(r.seconds for s, r in got.items() if s != "total")
    assert [r.no for r in stages.orderBy("no").collect()] == list(range(1, len(got) + 1))


def test_a_failing_stage_is_named(spark):
    stages = Stages(spark)
    with pytest.raises(Exception, match="bad number"), stages:
        stages.cut(spark.range(3), "good")
        stages.cut(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("bad number"))).otherwise(F.col("id")).alias("id")), "parse")
    last = stages.table().orderBy(F.desc("no")).first()
    assert (last.stage, last.rows, last.status) == ("total", 3, "error") and last.message.startswith("parse: ")
