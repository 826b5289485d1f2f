"""Ratcliff-Obershelp similarity: the functions for which Spark has no built-in, as Arrow-batched UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import COMMON_TERMS, tokens


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / (len a + len b); the argument order matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Whether the lengths allow a ratio of ``cutoff``: 2 * the shorter / the sum bounds it from above."""
    return 2 * F.least(F.length(a), F.length(b)) >= cutoff * (F.length(a) + F.length(b))


def char_signature(word: Column) -> Column:
    """The characters of a word as bits of a long: of each of 32 classes of characters whether it has one, and whether it has two.

    A class is a code point modulo 32, so other characters may share it. What a class has beyond two is in no bit.
    """

    def mark(bits: Column, char: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * F.pmod(F.ascii(char), F.lit(32))).cast("int"))
        return bits.bitwiseOR(F.when(bits.bitwiseAND(one) == 0, one).otherwise(F.shiftleft(one, 1)))

    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("long"), mark)


def ratio_bound(a: Column, sig_a: Column, b: Column, sig_b: Column) -> Column:
    """An upper bound of the ratio: twice the characters that both words can have in common over the sum of their lengths.

    Matched characters are common to both as multisets, which is at most what their classes share: the common bits, and of
    what is beyond two of a class the smaller sum. So a pair below a cutoff by this bound is below it by the ratio.
    """
    beyond = F.least(F.length(a) - F.bit_count(sig_a), F.length(b) - F.bit_count(sig_b))
    return 2.0 * (F.bit_count(sig_a.bitwiseAND(sig_b)) + beyond) / (F.length(a) + F.length(b))


def candidate_pairs(words: DataFrame, terms: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """keys, word, term: the pairs of ``words(keys, word)`` and ``terms(keys, term)`` whose ratio may reach the cutoff.

    They are blocked by keys and length, with the bound that a ratio sets on lengths, and kept by the bound of their
    characters, both in the JVM; no pair that reaches the cutoff is lost. Two empty words are no pair.
    """
    low, high = F.ceil(F.length("word") * cutoff / (2 - cutoff)), F.floor(F.length("word") * (2 - cutoff) / cutoff)
    w = words.select(*keys, "word", char_signature(F.col("word")).alias("ws"), F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("len"))
    t = terms.select(*keys, "term", char_signature(F.col("term")).alias("ts"), F.length("term").alias("len"))
    both = w.join(t, [*keys, "len"]).where(ratio_may_reach(F.col("word"), F.col("term"), cutoff))
    return both.where(ratio_bound(F.col("word"), F.col("ws"), F.col("term"), F.col("ts")) >= cutoff - 1e-9).select(*keys, "word", "term")


def corrections(words: DataFrame, vocab: DataFrame, cutoff: float = 0.75, most_change: int | None = 3, shortest: int = 4) -> DataFrame:
    """exam_id, word, corrected for the distinct ``words(exam_id, word)`` against ``vocab(exam_id, term)``.

    The best term by ratio is taken (of equal ratios the larger word), then dropped if its length differs by over
    ``most_change``. Words below ``shortest`` characters and words of the vocabulary stay. Only pairs that may reach the
    cutoff by length and by their characters are rated.
    """
    one = words.select("exam_id", "word").where("word is not null").distinct()
    terms = vocab.select("exam_id", "term").where("term is not null").distinct()
    known = terms.select("exam_id", F.col("term").alias("word"), F.lit(True).alias("known"))
    asked = one.join(known, ["exam_id", "word"], "left").where(F.col("known").isNull() & (F.length("word") >= shortest)).drop("known")
    rated = candidate_pairs(asked, terms, ["exam_id"], cutoff).withColumn("ratio", sequence_ratio(F.col("term"), F.col("word"))).where(F.col("ratio") >= cutoff)
    best = rated.groupBy("exam_id", "word").agg(F.max(F.struct("ratio", "term")).alias("best"))
    term = F.col("best.term")
    kept = F.when(term.isNotNull() & (F.lit(most_change is None) | (F.abs(F.length(term) - F.length("word")) <= (most_change or 0))), term).otherwise(F.col("word"))
    return one.join(best, ["exam_id", "word"], "left").select("exam_id", "word", kept.alias("corrected"))


def correct_spelling(answers: DataFrame, vocab: DataFrame, **rules) -> DataFrame:
    """``answers(exam_id, answer_id, text)`` with ``corrected``: each token replaced by its correction, joined by spaces.

    ``vocab`` is widened by the common terms. Only distinct tokens are rated; a null or blank text becomes empty.
    """
    spread = answers.select("exam_id", "answer_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    common = answers.select("exam_id").distinct().withColumn("term", F.explode(F.lit(COMMON_TERMS)))
    fixed = corrections(spread, vocab.select("exam_id", "term").union(common), **rules)
    joined = spread.join(fixed, ["exam_id", "word"]).groupBy("exam_id", "answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "corrected"))).alias("w"))
    out = answers.join(joined, ["exam_id", "answer_id"], "left")
    return out.select(*answers.columns, F.coalesce(F.array_join(F.col("w.corrected"), " "), F.lit("")).alias("corrected"))


def correct_by_list(texts: DataFrame, dictionary: list[str], cutoff: float = 0.75) -> DataFrame:
    """``texts(text_id, text)`` with ``corrected``: each token replaced by its close match in a short list, whatever its length."""
    answers = texts.select(F.lit(0).alias("exam_id"), F.col("text_id").alias("answer_id"), "text")
    spread = answers.select("exam_id", "answer_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    vocab = texts.sparkSession.createDataFrame([(0, w) for w in dictionary], "exam_id int, term string")
    fixed = corrections(spread, vocab, cutoff, most_change=None, shortest=1)
    joined = spread.join(fixed, ["exam_id", "word"]).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "corrected"))).alias("w"))
    out = answers.join(joined, "answer_id", "left")
    return out.select(F.col("answer_id").alias("text_id"), "text", F.coalesce(F.array_join(F.col("w.corrected"), " "), F.lit("")).alias("corrected"))
