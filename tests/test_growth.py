"""Memory and work that must not grow faster than the input."""

import pytest
from pyspark.sql import functions as F

from lumora.operators import align, paper, similarity
from lumora.plans import queries
from lumora.sources import tables

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vector_leaves_a_task(spark):
    """Vectors of all candidates and windows were stored: about 3 KB for each word of an answer."""
    pairs = spark.createDataFrame([(1, "the tree grows tall", "tall trees grow"), (2, None, "x"), (3, "", "y"), (4, "of the", "the of")], "answer_id int, student string, model string")
    df = similarity.score_answers(pairs)
    assert "vector" not in plan(df)
    got = {r.answer_id: r for r in df.collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[2].feedback == got[3].feedback == "Empty answer"
    assert got[4].details.matched_concepts == ["the of"]


def test_cosines_in_batches(spark, monkeypatch):
    """Each row's own texts against each other, whatever the number of rows and texts at once."""
    monkeypatch.setattr(similarity, "TEXTS", 5)
    words = ["tree", "trees", "root", "leaf", ""]
    rows = [(i, words[: i % 5 + 1], words[i % 3 :][: i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, q array<string>, w array<string>").coalesce(2)
    got = {r.id: r for r in df.select("id", similarity.cosines(similarity.lexical_encoder, F.col("q"), F.col("w")).alias("c")).collect()}
    flat = df.select("id", F.posexplode("q").alias("i", "q"), "w").select("id", "i", "q", F.posexplode("w").alias("j", "w"))
    v = flat.select("id", "i", "j", similarity.lexical_encoder("q").alias("a"), similarity.lexical_encoder("w").alias("b"))
    want = v.select("id", "i", "j", similarity.cosine(F.col("a"), F.col("b")).alias("s")).collect()
    assert len(want) == sum(len(q) * len(w) for _, q, w in rows)
    assert all(got[r.id].c[r.i][r.j] == pytest.approx(r.s, abs=1e-12) for r in want)
    best = {r.id: r.b for r in df.select("id", similarity.best_cosines(similarity.lexical_encoder, F.col("q"), F.col("w")).alias("b")).collect()}
    assert all(best[i] == pytest.approx([max(x, default=0.0) for x in got[i].c]) for i, _, _ in rows)


@pytest.mark.parametrize("name", ["expected_union", "align_exact", "align_base", "align_subparts", "not_attempted", "key_alignment", "paper_schema", "paper_rubric"])
def test_partitions_grow_with_the_rows(spark, monkeypatch, name):
    """Exams were dealt to as many partitions as there are cores, so a task's rows grew with the table."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = tables.parts(spark, D)
        assert n > 40
        assert queries.QUERIES[name](spark, D).rdd.getNumPartitions() >= (n if name != "align_subparts" else 1)
        assert f", {n}), REPARTITION_BY_NUM" in plan(queries.QUERIES[name](spark, D))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_that_repeat(spark):
    m = spark.createDataFrame([(1, "1"), (1, "1"), (1, "2a"), (2, "3")], "exam_id int, q_key string")
    s = spark.createDataFrame([(1, "1"), (1, "2"), (1, "2"), (3, "9")], "exam_id int, q_key string")
    got = {r.exam_id: tuple(r)[1:] for r in align.key_alignment(m, s, 3).collect()}
    assert got == {1: (1, 1, 1, 0.5), 2: (0, 1, 0, 0.0), 3: (0, 0, 1, 0.0)}


def test_schema_finds_rows_once(spark):
    """The garbage rule joined the rows with themselves, so each line was matched twice."""
    papers = spark.createDataFrame([(1, "7. a) |Tell 5\n8. |Tell of it 5"), (2, "Q21. Tell [5 marks]"), (3, "Max. Marks: 50"), (4, "")], "exam_id int, text string")
    df = paper.schema_state(papers)
    assert "LeftAnti" not in plan(df)
    assert {r.exam_id: (r.n_keys, r.total_marks, r.kind) for r in df.collect()} == {1: (2, None, "rubric"), 2: (0, None, "none"), 3: (0, 50, "total"), 4: (0, None, "none")}
