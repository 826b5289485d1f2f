import pytest
from pyspark.sql import functions as F

from lumora.functions import text as tf
from lumora.operators import lexical


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("Post-Pruning, (x=2)!", "post-pruning, x2"), (None, ""), ("", ""), ("  a \n b ", "a b"), ("Été", "t")])
def test_clean_text(spark, text, want):
    assert one(spark, tf.clean_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("Tjhe rtoot kof 17 a 3b2 trme 08 si dpee", 0.3), ("binary search algorithm has best case O1 and worst case Ologn", 1 / 11), ("", 0.0), (None, 0.0)])
def test_noise_ratio(spark, text, want):
    assert one(spark, tf.noise_ratio(F.col("t")), t=text) == pytest.approx(want)


def test_rescue_hits(spark):
    words = F.array(*[F.lit(w) for w in ("binary", "search", "algorithm", "complexity", "logarithmic")])
    assert one(spark, tf.rescue_hits(words, F.col("t")), t="binary search algorithm") == 3


@pytest.mark.parametrize("a, b, want", [("pruning", "prunign", True), ("tree", "trea", True), ("tree", "bree", False), ("abc", "abc", False), ("tree", "treeing", False), ("nodes", "snode", False)])
def test_fuzzy_equal(spark, a, b, want):
    assert one(spark, tf.fuzzy_equal(F.col("a"), F.col("b")), a=a, b=b) is want


def test_windows(spark):
    words = [f"w{i}" for i in range(32)]
    got = one(spark, tf.word_windows(F.col("t")), t=" ".join(words))
    want = [" ".join(words[i : i + 6]) for i in range(0, 27, 3)] + [" ".join(words[-6:])]
    assert got == want
    assert one(spark, tf.word_windows(F.col("t")), t="a b") == ["a b"]


def test_scores_stay_in_range(spark):
    rows = spark.range(0, 400).select((F.col("id") / 200 - 1).alias("s"), (F.col("id") % 2 == 0).alias("n"), (F.col("id") % 11 / 10).alias("c"), (F.col("id") % 4).alias("h"), (F.col("id") % 12).alias("w"))
    x = rows.select(tf.final_score(F.col("s"), F.col("n"), F.col("c"), F.col("h"), F.col("w")).alias("f")).agg(F.min("f").alias("lo"), F.max("f").alias("hi")).first()
    assert 0 <= x.lo <= x.hi <= 1


def test_pair_scores(spark):
    pairs = spark.createDataFrame([("1", "the tree has nodes", "tree nodes branches"), ("2", "", "x y"), ("3", None, None)], "pair_id string, student string, model string")
    got = {r.pair_id: r.o for r in pairs.select("pair_id", lexical.overlap(F.col("student"), F.col("model")).alias("o")).collect()}
    assert got == {"1": pytest.approx(2 / 3), "2": 0.0, "3": 0.0}
    cos = {r.pair_id: r.tfidf for r in lexical.tfidf_cosine(pairs).collect()}
    assert 0 < cos["1"] < 1 and cos["2"] == 0.0 and cos["3"] == 0.0


def test_spelling(spark):
    from lumora.functions.fuzzy import correct_spelling

    a = spark.createDataFrame([(1, 1, "prunning the tre graphs zzzzzz"), (1, 2, None)], "exam_id int, answer_id int, text string")
    v = spark.createDataFrame([(1, "graph")], "exam_id int, term string")
    got = {r.answer_id: r.corrected for r in correct_spelling(a, v).collect()}
    assert got == {1: "pruning the tre graph zzzzzz", 2: ""}
