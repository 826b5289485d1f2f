"""Exact filters against brute force: what they leave out could not have counted, and they leave out most."""

from difflib import SequenceMatcher

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumora.functions import fuzzy
from lumora.operators import lexical, paper, similarity
from lumora.plans import queries
from lumora.sources import tables

D = "/root/testdata/sf0.01"


def signature(word):
    bits = 0
    for c in word:
        one = 1 << 2 * (ord(c) % 32)
        bits |= (one << 1) if bits & one else one
    return bits


@settings(max_examples=400, deadline=None)
@given(st.text("abcdeöé1-", max_size=14), st.text("abcdeöé1-", max_size=14))
def test_the_bound_is_never_below_the_ratio(a, b):
    x, y = signature(a), signature(b)
    beyond = min(len(a) - x.bit_count(), len(b) - y.bit_count())
    bound = 2 * ((x & y).bit_count() + beyond) / (len(a) + len(b)) if a or b else 1
    assert bound >= SequenceMatcher(None, a, b).ratio() - 1e-9


def test_signatures_in_the_engine(spark):
    words = ["", "a", "aaa", "tree", "Straße", "été-été", "\U0001f600x", "z" * 300]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", fuzzy.char_signature(F.col("w")).alias("s")).collect()
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    assert {r.w: r.s for r in got} == {w: signed(signature(w)) for w in words}


def test_few_pairs_are_rated(spark):
    """Of the pairs that meet by length less than a fifth goes to the rating, and no match is lost."""
    words = queries._misspelt(spark, D).select("exam_id", F.explode(F.split("text", " ")).alias("word")).where("length(word) > 3").distinct()
    terms = queries._vocabulary(spark, D)
    exam = {}
    for r in terms.collect():
        exam.setdefault(r.exam_id, []).append(r.term)
    asked = [r for r in words.collect() if r.word not in exam[r.exam_id]]
    by_length, matches = 0, set()
    for r in asked:
        for t in exam[r.exam_id]:
            if 2 * min(len(t), len(r.word)) >= 0.75 * (len(t) + len(r.word)):
                by_length += 1
                if SequenceMatcher(None, t, r.word).quick_ratio() >= 0.75 and SequenceMatcher(None, t, r.word).ratio() >= 0.75:
                    matches.add((r.exam_id, r.word, t))
    kept = {tuple(r) for r in fuzzy.candidate_pairs(spark.createDataFrame([(r.exam_id, r.word) for r in asked], words.schema), terms, ["exam_id"], 0.75).collect()}
    assert matches and matches <= kept and len(kept) * 5 < by_length


def test_overlap_meets_few_documents(spark):
    docs, items = tables.read(spark, D, "documents").select("doc_id", "text"), tables.read(spark, D, "benchmark").select("item_id", "text")
    words = lambda df, key: {r[0]: set(r[1]) for r in df.select(key, lexical.overlap_words(F.col("text"))).collect()}
    d, i = words(docs, "doc_id"), words(items, "item_id")
    want = {}
    for item, w in i.items():
        n, back = max((len(w & x), -k) for k, x in d.items())
        want[item] = (-back, n)
    assert {r.item_id: (r.doc_id, r.n_common) for r in lexical.best_overlap(docs, items).collect()} == want
    met = lexical.overlap_candidates(docs, items).count()
    all_pairs = sum(bool(w & x) for w in i.values() for x in d.values())
    print("pairs", met, "of", all_pairs)
    assert met * 10 < len(d) * len(i)


def test_overlap_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "beta alpha gamma"), (5, "x " * 5000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "unseen words"), (4, "x gamma beta"), (5, "")], "item_id long, text string")
    assert {r.item_id: (r.doc_id, r.n_common) for r in lexical.best_overlap(docs, items).collect()} == {1: (1, 2), 4: (4, 2)}
    assert lexical.best_overlap(docs.limit(0), items).collect() == []


def test_windows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(similarity, "BLOCK", 7)
    vectors = rng.normal(size=(120, 16)).round(3)
    vectors[5] = 0
    vectors[17] = vectors[3]
    q = [(a, i, [float(x) for x in vectors[rng.integers(120)]]) for a in range(3) for i in range(11)]
    w = [(a, i, [float(x) for x in vectors[(i * 7 + a) % 120]]) for a in range(2) for i in range(60)]
    schema = "answer_id int, {} int, vector array<float>"
    got = similarity.best_windows(spark.createDataFrame(q, schema.format("query_id")), spark.createDataFrame(w, schema.format("window_id")))
    unit = lambda v: np.array(v, np.float32).astype(float) / (np.linalg.norm(np.array(v, np.float32).astype(float)) or 1)
    want = {}
    for a, i, v in q:
        own = [(round(float(unit(v) @ unit(x)), 9), -j) for b, j, x in w if b == a]
        if own:
            want[a, i] = (-max(own)[1], max(own)[0])
    assert {(r.answer_id, r.query_id): (r.window_id, round(r.similarity, 9)) for r in got.collect()} == want


def test_sides_of_an_or(spark):
    """The last row above and the first below, on random papers, against a search of all rows; both ways of measuring."""
    rng = np.random.default_rng(5)
    papers = []
    for e in range(60):
        lines = [str(rng.choice(["OR", "", f"{int(rng.integers(1, 15))}. |Tell of it 5", f"{int(rng.integers(1, 15))}) b) Tell 4", "words", "Bonus part"])) for _ in range(int(rng.integers(0, 14)))]
        papers.append((e, "\n".join(lines)))
    df = spark.createDataFrame(papers, "exam_id int, text string")
    rows = paper.question_rows(df)
    own = {}
    for r in rows.collect():
        own.setdefault(r.exam_id, []).append((r.line_no, int(r.q_key.rstrip("b")), r.q_key))
    for before in (False, True):
        got = {(r.exam_id, r.q_key): r.group_id for r in paper.or_groups(rows, df, before).collect()}
        for e, text in papers:
            lines, shared = text.split("\n"), {}
            for i, line in enumerate(lines):
                if line == "OR":
                    at = max((j for j in range(i) if lines[j].strip()), default=None) if before else i
                    up = [(n, b) for n, b, _ in own.get(e, []) if at is not None and n < at]
                    down = [(n, b) for n, b, _ in own.get(e, []) if at is not None and n > at]
                    if up and down and max(up)[1] != min(down)[1]:
                        a, b = max(up)[1], min(down)[1]
                        shared[a] = shared[b] = min(a, b)
            assert {k: g for (x, k), g in got.items() if x == e} == {k: str(shared[b]) if b in shared else k for _, b, k in own.get(e, [])}
