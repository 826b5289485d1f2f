"""Queries that SQL cannot express, against plain Python over whole tables."""

from collections import defaultdict
from difflib import SequenceMatcher, get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from lumora.functions.fuzzy import correct_by_list
from lumora.functions.text import COMMON_TERMS
from lumora.operators import align, lexical, paper, segment, similarity
from lumora.plans import grade, queries
from lumora.sources import tables

D = "/root/testdata/sf0.001"


def test_spelling_against_difflib(spark):
    vocab = defaultdict(set)
    for r in queries._vocabulary(spark, D).collect():
        vocab[r.exam_id].add(r.term)
    for r in e.queries()["spell_correct"](spark, D).collect():
        words, want = sorted(vocab[r.exam_id] | set(COMMON_TERMS)), []
        for w in r.text.split():
            best = get_close_matches(w, words, n=1, cutoff=0.75) if len(w) > 3 and w not in words else []
            want.append(best[0] if best and abs(len(best[0]) - len(w)) <= 3 else w)
        assert r.corrected == " ".join(want)


def test_short_list(spark):
    got = {r.text_id: r.corrected for r in correct_by_list(spark.createDataFrame([(1, "the graf prunning"), (2, None)], "text_id int, text string"), ["graph", "pruning"]).collect()}
    assert got == {1: "the graf pruning" if not get_close_matches("graf", ["graph"], 1, 0.75) else "the graph pruning", 2: ""}


def test_fuzzy_cover_against_difflib(spark):
    pairs = tables.dialogue_pairs(spark, D)
    keys = {r.pair_id: sorted(set(" ".join(r.keywords).split(" "))) for r in lexical.keyword_lists(pairs).collect()}
    words = {r.pair_id: set((r.student or "").split()) for r in pairs.collect()}
    for r in lexical.fuzzy_coverage(pairs).collect():
        hits = sum(any(SequenceMatcher(None, w, k).ratio() >= 0.7 for w in words[r.pair_id]) for k in keys[r.pair_id])
        assert (r.n_keywords, r.n_matched) == (len(keys[r.pair_id]), hits)


def test_greedy_against_a_loop(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").collect()
    exams = defaultdict(lambda: ([], []))
    for r in rows:
        exams[r.vec_id // 40][1 - r.vec_id % 2].append(r)
    want = set()
    unit = lambda v: np.array(v, float) / np.linalg.norm(np.array(v, float))
    for exam, (m, s) in exams.items():
        used = set()
        for x in sorted(m, key=lambda r: str(r.vec_id)):
            free = [(float(unit(x.embedding) @ unit(y.embedding)), -y.vec_id) for y in s if y.vec_id not in used]
            if free and max(free)[0] > 0.2:
                used.add(-max(free)[1])
                want.add((exam, str(x.vec_id), str(-max(free)[1])))
    assert {(r.exam_id, r.m_key, r.s_key) for r in e.queries()["greedy_semantic"](spark, D).collect()} == want


def test_one_join_aligns_as_three_steps(spark):
    m = [(1, k) for k in ("1", "2a", "2b", "3", "4", "5", "6a")] + [(2, "1")]
    s = [(1, 1, k, f"t{k}") for k in ("1", "2", "3a", "3b", "4a", "4", "6b", "9")] + [(1, 2, "2a", "x"), (1, 2, "2", "y"), (2, 1, "1b", "z")]
    models, students = spark.createDataFrame(m, "exam_id int, q_key string"), spark.createDataFrame(s, "exam_id int, student_id int, q_key string, text string")
    exact, base = align.align_exact(models, students), align.align_base(models, students)
    parts = align.align_parts(models, students, exact.union(base))
    key = lambda df, how: {(r.exam_id, r.student_id, r.m_key, r.s_key, how) for r in df.collect()}
    want = key(exact, "exact") | key(base, "base") | key(parts.withColumn("s_key", F.explode("s_keys")), "part")
    got = align.align_keys(models, students)
    assert {tuple(r) for r in got.collect()} == want and {"exact", "base", "part"} == {w[-1] for w in want}
    assert {(r.m_key, r.text) for r in align.joined_parts(got, students).collect()} == {(r.m_key, r.text) for r in parts.collect()}


def test_paper(spark):
    lines = ["Max marks: 60", "1) a] | Sketch a heap  4 | PO2", "2 . |Name two sorts 30 |CO1", "3. |Draw a queue 5 \\", "or", "  OR ", "4. b) Compare lists 5 |cO3", "3. |Again 2 |CO1", "extra credit below", "12. |Hash maps 6", "16. |Too high 6"]
    p = spark.createDataFrame([(1, "\n".join(lines)), (2, "Q1. Tell of trees [5 marks]\nQ2. Tell of graphs marks: 7"), (3, None), (4, "full marks 70")], "exam_id int, text string")
    rows = {(r.exam_id, r.q_key): (r.line_no, r.marks) for r in paper.question_rows(p).collect()}
    assert rows == {(1, "1a"): (1, 4), (1, "3"): (3, 5), (1, "4b"): (6, 5), (1, "12"): (9, 6), (2, "1"): (0, 5), (2, "2"): (1, 7)}
    got = {(r.exam_id, r.q_key): (r.max_marks, r.q_type, r.group_id) for r in paper.rubric(p).collect()}
    assert got[1, "3"] == (5, "optional", "3") and got[1, "4b"] == (5, "optional", "3") and got[1, "12"] == (6, "challenge", "12") and got[1, "1a"] == (4, "mandatory", "1a")
    state = {r.exam_id: (r.n_keys, r.total_marks, r.kind) for r in paper.schema_state(p).collect()}
    assert state == {1: (4, 60, "rubric"), 2: (2, None, "rubric"), 3: (0, None, "none"), 4: (0, 70, "total")}
    wild = spark.createDataFrame([(1, "3"), (1, "21"), (2, "4a")], "exam_id int, q_key string")
    assert [r.q_key for r in paper.usable_rows(wild).collect()] == ["4a"]


@pytest.mark.parametrize("pages, n, want", [(2, 2, 2), (6, 2, 4), (1, 3, 1)])
def test_chunks_keep_the_rest(spark, pages, n, want):
    text = segment.PAGE_BREAK.join(f"this is page number {i} of the whole text" for i in range(pages))
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(segment.chunks(F.col("t"), F.lit(n)).alias("a"), segment.chunks(F.col("t"), F.lit(n), keep_rest=False).alias("b")).first()
    assert len(got.a) == want and all(f"number {i} " in " ".join(got.a) for i in range(pages))
    assert got.b == got.a[: len(got.b)] or len(got.b) == n + 2


def test_expected_keys_fall_back_to_chunks(spark):
    texts = spark.createDataFrame([(1, "first thoughts on sorting things\n\nsecond thoughts on searching them\n\nthird thoughts on storing them")], "doc_id int, text string")
    want = spark.createDataFrame([(1, ["1", "2", "3", "_total"])], "doc_id int, q_keys array<string>")
    got = {r.q_key: r.text for r in segment.segment_with_fallback(texts, want).collect()}
    assert set(got) == {"1", "2", "3"} and "first thoughts" in got["1"] and len(got["2"]) > 10


def test_answers(spark):
    rows = [(1, "binary search halves the sorted list at every step it takes", "binary search halves the sorted list at every step"), (2, "", "x"), (3, None, None), (4, "bananas are yellow fruit", "binary search halves the sorted list at every step")]
    got = {r.answer_id: r for r in similarity.score_answers(spark.createDataFrame(rows, "answer_id int, student string, model string")).collect()}
    assert got[1].score >= 8.5 and got[1].feedback.startswith("Excellent") and not got[1].details.missing_concepts
    assert got[2].score == got[3].score == 0.0 and got[2].feedback == "Empty answer" and got[3].details is None
    assert got[4].score <= 1.5 and "Consider adding" in got[4].feedback and len(got[4].details.missing_concepts) == 8


def test_whole_exam(spark):
    """Two parts against one alternative: the pair wins if it has more marks; what nobody wrote is not attempted."""
    a, b = "a heap keeps the smallest key at its root after every change", "a queue hands things out in the order in which they came"
    models = spark.createDataFrame([(1, "7a", a), (1, "7b", b), (1, "8", a + " and " + b), (1, "9", "a stack hands out the newest thing first of all")], "exam_id int, q_key string, text string")
    rubric = spark.createDataFrame([(1, "7a", 8, "optional", "7"), (1, "7b", 6, "optional", "7"), (1, "8", 14, "optional", "7"), (1, "9", 6, "mandatory", "9")], "exam_id int, q_key string, max_marks int, q_type string, group_id string")
    exams = spark.createDataFrame([(1, 20)], "exam_id int, total_marks int")
    students = spark.createDataFrame([(1, 1, "7a", 0, a), (1, 1, "7b", 1, b), (1, 2, "8", 0, a + " and " + b)], "exam_id int, student_id int, q_key string, ord int, text string")
    rows, totals = grade.grade(models, students, rubric, exams)
    got = {(r.student_id, r.q_key): (r.selected, r.score, r.feedback) for r in rows.collect()}
    assert got[1, "7a"][0] and got[1, "7b"][0] and not got[1, "8"][0] and got[2, "8"][0] and not got[2, "7a"][0]
    assert got[1, "9"][1:] == (0.0, "Not Attempted") and got[1, "8"][2].endswith("(OR alternative -- not counted)")
    assert got[1, "7a"][1] > 6 and {(r.student_id, r.max_score) for r in totals.collect()} == {(1, 20), (2, 20)}
