"""Open answers of an exam are matched by their whole texts, not by how they begin."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lumora.operators import similarity
from lumora.plans import grade, queries
from lumora.plans.oracles import ORACLES

SAME = "the answer begins with the same polite words " * 12
HEAPS, QUEUES = "a heap keeps its smallest key at the root " * 40, "first come first served waiting customers leave " * 40


@pytest.fixture(scope="module")
def dialogue(spark, tmp_path_factory):
    """Replies under keys 7 and 5, whose texts are parts 1a and 3a of the sheet and begin with the same 540 characters."""
    d = str(tmp_path_factory.mktemp("dialogue"))
    rows = [(1, 0, "user", "tell me"), (1, 3, "assistant", SAME + HEAPS), (1, 4, "user", "go on"), (1, 8, "assistant", SAME + QUEUES)]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).to_parquet(f"{d}/conversations.parquet")
    return d


def twin(name, d):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    return con.sql(ORACLES[name]).df()


def test_grade_rows_by_whole_texts(spark, dialogue):
    """Equal beginnings were a tie, so key 5 took the first part."""
    columns = ["exam_id", "q_key", "score", "max_marks", "feedback"]
    got = {tuple(r) for r in queries.QUERIES["grade_rows"](spark, dialogue).select(*columns).collect()}
    assert {r[1]: r[4][r[4].index(" (matched") :] for r in got} == {"5": " (matched to Q3a)", "7": " (matched to Q1a)"}
    assert got == {tuple(r) for r in twin("grade_rows", dialogue)[columns].itertuples(index=False)}


def test_batches_are_bounded_by_bytes(monkeypatch):
    """Long texts were encoded 2048 at once; now as many as fit, each row whole, and the cosines stay the same."""
    seen = []

    def counted(batches):
        for b in batches:
            seen.append(sum(len((t or "").encode()) for t in b))
            yield from similarity.lexical_encoder.func(iter([b]))

    rows = [["heap" * (i % 7), "été " * i, None] for i in range(40)] + [None, [], ["x" * 500]]
    q, w = pa.array(rows, pa.list_(pa.string())), pa.array(rows[::-1], pa.list_(pa.string()))
    run = lambda: [m for some in similarity._products(SimpleNamespace(func=counted), iter([(q.slice(3), w.slice(3)), (q, w)])) for m in some]
    whole = run()
    assert len(seen) == 2
    seen.clear()
    monkeypatch.setattr(similarity, "BYTES", 400)
    parts = run()
    most = max(sum(len((t or "").encode()) for t in (a or []) + (b or [])) for a, b in zip(rows, rows[::-1]))
    assert len(seen) > 20 and max(seen) <= max(400, most)
    assert len(parts) == len(whole) == 83 and all(np.array_equal(a, b) for a, b in zip(parts, whole))


def test_grade_stages_by_whole_texts(spark):
    """Beginnings with nothing in common: the key was counted as not attempted, and no answer was written."""
    models = spark.createDataFrame([(1, "1", "zebu " * 120 + HEAPS)], "exam_id int, q_key string, text string")
    students = spark.createDataFrame([(1, 1, "5", 0, "quill " * 100 + HEAPS)], "exam_id int, student_id int, q_key string, ord int, text string")
    rubric = spark.createDataFrame([(1, "1", 10, "mandatory", "1"), (1, "2", 10, "mandatory", "2"), (1, "3", 10, "mandatory", "3")], "exam_id int, q_key string, max_marks int, q_type string, group_id string")
    stages = grade.timed_grade(models, students, rubric, spark.createDataFrame([(1, 10)], "exam_id int, total_marks int"))[2]
    got = {r.stage: (r.rows, r.errors, r.status) for r in stages.collect()}
    assert got["alignment"] == (0, 0, "done") and got["answers"] == (1, 0, "done") and got["scores"] == (1, 0, "done")


def test_grade_totals_by_whole_texts(spark, dialogue):
    """Each reply meets the part with its own text, so all marks are got."""
    columns = ["exam_id", "student_id", "obtained", "possible", "total_score", "max_score"]
    got = [tuple(r) for r in queries.QUERIES["grade_totals"](spark, dialogue).select(*columns).collect()]
    assert got == [(1, 1, 50.0, 50, 50.0, 50)]
    assert got == [tuple(r) for r in twin("grade_totals", dialogue)[columns].itertuples(index=False)]
