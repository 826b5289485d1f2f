"""Similarity and the score of one answer: cosine, best windows, concepts, hits, blend, floors, feedback.

Vectors come from an encoder that is a parameter, a pandas UDF over an iterator of texts; the default is a deterministic lexical
one (character trigrams). Texts are encoded beside the rows that compare them, and only cosines leave a task. Score thresholds were tuned for a neural encoder; with another encoder
the same rules apply but marks differ.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.functions import text as tf

DIMENSIONS = 256
#: Words whose trigrams a task remembers.
WORDS_HELD = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a side has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def lexical_encoder(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Counts of the character trigrams of the lower-cased words, each word between ^ and $, in 256 places.

    The place of a trigram is (961 * first + 31 * second + third code point) modulo 256.
    """
    places: dict[str, np.ndarray] = {}  # of the words of this task
    for texts in batches:
        rows = [(t or "").lower().split() for t in texts]
        for w in set().union(*rows) - places.keys():
            c = np.array([94, *map(ord, w), 36], np.int64)
            places[w] = (961 * c[:-2] + 31 * c[1:-1] + c[2:]) % DIMENSIONS
        at = [np.concatenate([places[w] for w in r]) if r else np.empty(0, np.int64) for r in rows]
        row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
        counts = np.bincount(row * DIMENSIONS + np.concatenate(at), minlength=len(rows) * DIMENSIONS).reshape(len(rows), -1) if rows else np.zeros((0, DIMENSIONS))
        yield pd.Series(list(counts.astype(np.float32)))
        if len(places) > WORDS_HELD:
            places.clear()


#: Texts that are encoded at once, and their bytes: a row with more is encoded alone.
TEXTS = 2048
BYTES = 1_000_000


def _products(encoder, batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[list[np.ndarray]]:
    """The cosines of each row's queries (down) and windows (across), for some rows at a time; 0.0 where a side has no length.

    The vectors live as long as their rows are at hand: a text of n words has about 3 n candidates of 1 KB each.
    """
    asked: deque[tuple[np.ndarray, np.ndarray]] = deque()

    def bytes_until(x: pa.Array, n: np.ndarray) -> np.ndarray:
        each = np.asarray(pc.fill_null(pc.binary_length(x.flatten()), 0), np.int64)
        return np.concatenate([[0], np.cumsum(each)])[np.cumsum(n)]

    def texts() -> Iterator[pd.Series]:
        for q, w in batches:
            n = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)) for x in (q, w)]
            ends, sizes, start = np.cumsum(n[0] + n[1]), bytes_until(q, n[0]) + bytes_until(w, n[1]), 0
            while start < len(q):
                fit = (int(np.searchsorted(e, (e[start - 1] if start else 0) + most, "right")) for e, most in ((ends, TEXTS), (sizes, BYTES)))
                stop = max(start + 1, min(fit))
                asked.append((n[0][start:stop], n[1][start:stop]))
                yield pd.Series(np.concatenate([x.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False) for x in (q, w)]), dtype=object)
                start = stop

    for vectors in encoder.func(texts()):
        n_q, n_w = asked.popleft()
        v = np.array(list(vectors), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
        norms = np.sqrt((v * v).sum(1))
        q_ends, w_ends = np.cumsum(n_q), n_q.sum() + np.cumsum(n_w)
        rows = []
        for i in range(len(n_q)):
            q, w = slice(q_ends[i] - n_q[i], q_ends[i]), slice(w_ends[i] - n_w[i], w_ends[i])
            n = np.outer(norms[q], norms[w])
            rows.append(np.divide(v[q] @ v[w].T, n, out=np.zeros_like(n), where=n > 0))
        yield rows


def cosines(encoder, queries: Column, windows: Column) -> Column:
    """array<array<double>>: of two arrays of texts, for each of the first its cosine to each of the second."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows in _products(encoder, batches):
            yield pa.array([[list(x) for x in m] for m in rows], pa.list_(pa.list_(pa.float64())))

    return of(queries, windows)


def best_cosines(encoder, queries: Column, windows: Column) -> Column:
    """array<double>: for each of the first texts its greatest cosine to one of the second; 0.0 where there is none."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows in _products(encoder, batches):
            yield pa.array([m.max(1) if m.shape[1] else np.zeros(len(m)) for m in rows], pa.list_(pa.float64()))

    return best(queries, windows)


#: Queries or windows of an answer that are multiplied at once.
BLOCK = 256


def _units(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(vectors), -1) if len(flat) else np.zeros((len(vectors), 1))
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def best_windows(queries: DataFrame, windows: DataFrame) -> DataFrame:
    """answer_id, query_id, window_id, similarity: the most similar window of the same answer (ties: smallest id).

    ``queries(answer_id, query_id, vector)`` and ``windows(answer_id, window_id, vector)`` meet on the answer, in blocks of at
    most 256 by 256 (ids that lie together share a block), and a block is one product of matrices in an Arrow batch.
    """

    def blocks(rows: DataFrame, id_: str, name: str) -> DataFrame:
        one = rows.select("answer_id", F.floor(F.col(id_) / BLOCK).alias("block"), F.struct(F.col(id_).cast("long").alias("id"), "vector").alias("x"))
        return one.groupBy("answer_id", "block").agg(F.collect_list("x").alias(name)).drop("block")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, w = (batch.column(c)[i].values for c in (1, 2))
                q_ids, w_ids = (x.field("id").to_numpy() for x in (q, w))
                order = np.argsort(w_ids, kind="stable")
                products = _units(q.field("vector")) @ _units(w.field("vector"))[order].T
                # rounded, so that ties don't hang on the order of additions
                at = np.round(products, 12).argmax(1)
                answer = batch.column(0).take(pa.array(np.full(len(q_ids), i)))
                yield pa.RecordBatch.from_arrays([answer, pa.array(q_ids), pa.array(w_ids[order][at]), pa.array(products[np.arange(len(q_ids)), at])], ["answer_id", "query_id", "window_id", "similarity"])

    met = blocks(queries, "query_id", "q").join(blocks(windows, "window_id", "w"), "answer_id").select("answer_id", "q", "w")
    each = met.mapInArrow(multiply, f"answer_id {dict(met.dtypes)['answer_id']}, query_id long, window_id long, similarity double")
    best = each.groupBy("answer_id", "query_id").agg(F.max(F.struct("similarity", (-F.col("window_id")).alias("back"))).alias("b"))
    return best.select("answer_id", "query_id", (-F.col("b.back")).alias("window_id"), F.col("b.similarity").alias("similarity"))


def candidate_ngrams(c: Column, longest: int = 3) -> Column:
    """Distinct runs of one to three words, stop words taken out before; words of two or more characters; sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)

    def runs(w: Column, n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    each = lambda w: F.concat(*[runs(w, n) for n in range(1, longest + 1)])
    return F.array_sort(F.array_distinct(tf.let(F.filter(words, lambda t: ~t.isin(tf.STOP_WORDS)), each)))


def key_concepts(models: DataFrame, top: int = 8, encoder=lexical_encoder) -> DataFrame:
    """``models(answer_id, text)`` with concepts: the candidates most similar to the whole text, the most similar first.

    Ties go by alphabet. A text without candidates is its own concept.
    """
    c = models.withColumn("candidates", candidate_ngrams(F.col("text")))
    c = c.withColumn("candidates", F.when(F.size("candidates") == 0, F.array("text")).otherwise(F.col("candidates")))
    c = c.withColumn("near", best_cosines(encoder, F.col("candidates"), F.array("text")))
    ranked = F.array_sort(F.zip_with("near", "candidates", lambda s, k: F.struct((0.0 - F.round(s, 9)).alias("far"), k.alias("concept"))))
    return c.select(*models.columns, F.transform(F.slice(ranked, 1, top), lambda x: x["concept"]).alias("concepts"))


def concept_hits(concepts: Column, best: Column, student: Column, noisy: Column) -> Column:
    """Of each concept whether it counts: inside the text, a fuzzy keyword, or high similarity. (The middle tiers are implied by these.)"""
    named = lambda low, found: F.transform(concepts, lambda k: F.contains(low, F.lower(k)) | tf.any_fuzzy(tf.keywords(k), found))
    worded = tf.let(F.lower(student), lambda low: tf.let(tf.keywords(student), lambda found: named(low, found)))
    high = F.when(noisy, 0.40).otherwise(0.55)
    # ``best`` comes from Python, so it stays outside of the lambdas
    return F.zip_with(worded, best, lambda hit, s: hit | (s > high))


def score_answers(answers: DataFrame, encoder=lexical_encoder) -> DataFrame:
    """answer_id, score (0 to 10, one decimal), feedback, details for ``answers(answer_id, student, model)``.

    ``details`` is a struct (similarity, concept_coverage, matched_concepts, missing_concepts), null for an empty side, which
    scores 0 with the feedback "Empty answer".
    """
    a = answers.select("answer_id", F.translate("student", "\n", " ").alias("student"), F.translate("model", "\n", " ").alias("model"))
    full = a.where((F.coalesce(F.length("student"), F.lit(0)) > 0) & (F.coalesce(F.length("model"), F.lit(0)) > 0)).withColumn("noisy", tf.noise_ratio(F.col("student")) > 0.30)
    # concepts belong to a model text, not to an answer: distinct models once
    models = full.select("model").distinct().select(F.col("model").alias("answer_id"), F.col("model").alias("text"))
    concepts = key_concepts(models, encoder=encoder).select(F.col("answer_id").alias("model"), "concepts")
    # windows are made before the join: a function in Python takes columns, not lambdas
    s = full.withColumn("windows", tf.word_windows(F.col("student"))).withColumn("sim", best_cosines(encoder, F.array("model"), F.array("student"))[0])
    s = s.join(concepts, "model").withColumn("best", best_cosines(encoder, F.col("concepts"), F.col("windows")))
    s = s.withColumn("hits", concept_hits(F.col("concepts"), F.col("best"), F.col("student"), F.col("noisy")))
    having = lambda hit: F.transform(F.filter(F.arrays_zip("concepts", "hits"), lambda x: x["hits"] == hit), lambda x: x["concepts"])
    s = s.withColumn("matched", having(True)).withColumn("missing", having(False)).withColumn("coverage", F.size("matched") / F.size("concepts"))
    final = tf.final_score(F.col("sim"), F.col("noisy"), F.col("coverage"), tf.rescue_hits(tf.keywords(F.col("model")), F.col("student")), F.size(tf.tokens(F.col("student"))))
    s = s.withColumn("final", final)
    details = F.struct(F.bround("sim", 2).alias("similarity"), F.bround("coverage", 2).alias("concept_coverage"), F.col("matched").alias("matched_concepts"), F.col("missing").alias("missing_concepts"))
    s = s.select("answer_id", F.bround(F.col("final") * 10, 1).alias("score"), tf.feedback(F.col("final"), F.col("missing")).alias("feedback"), details.alias("details"))
    return answers.select("answer_id").join(s, "answer_id", "left").select("answer_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("feedback", F.lit("Empty answer")).alias("feedback"), "details")
