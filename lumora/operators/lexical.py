"""Lexical scores: overlap, TF-IDF cosine of a pair, keywords, coverage, and their blend. All equi-joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.fuzzy import candidate_pairs, sequence_ratio
from lumora.functions.text import clean_strict, let, tokens
from lumora.sources.stored import stored

#: This engine's own list for the library's English stop words; short function words only.
ENGLISH_STOP = "a an and are as at be but by for from has have he her his i in is it its no not of on or she so that the their them they this to was we were which who will with you".split()


def overlap(student: Column, model: Column) -> Column:
    """Share of the model's distinct words that the student uses; 0.0 for an empty model."""
    s, m = F.array_distinct(tokens(student)), F.array_distinct(tokens(model))
    return F.when(F.size(m) == 0, 0.0).otherwise(F.size(F.array_intersect(s, m)) / F.size(m))


#: Rarest words of an item by which the first candidates are found, and how many of these are compared with it.
FIRST_WORDS, FIRST_DOCS = 4, 4


def overlap_words(c: Column) -> Column:
    return F.array_distinct(tokens(clean_strict(c)))


def overlap_candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_common, n_model for a few pairs of ``docs(doc_id, text)`` and ``items(item_id, text)``, with every best one.

    A prefix filter. An item's words are ordered from the rarest. The documents that hold most of the first four are compared
    first; the best of them shares b words. Any document that shares b words must hold one of all but the b - 1 most frequent,
    and have b words itself, so only those meet the item. All texts are cut into words once; of what they hold only the items'
    words are stored.
    """
    i = stored(items.select("item_id", overlap_words(F.col("text")).alias("words")), "overlap-items")
    asked = i.select("item_id", F.size("words").alias("n_model"), F.explode("words").alias("word"))
    spread = docs.select("doc_id", overlap_words(F.col("text")).alias("words")).select("doc_id", F.size("words").alias("n_doc"), F.explode("words").alias("word"))
    known = spread.join(asked.select("word").distinct(), "word", "left_semi")
    d = stored(known.groupBy("doc_id", "n_doc").agg(F.collect_list("word").alias("of_doc")), "overlap-words")
    held = d.select("doc_id", "n_doc", F.explode("of_doc").alias("word"))
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "word"))
    # words that no document holds cannot be shared
    ranked = stored(asked.join(df, "word").withColumn("rank", rank).withColumn("n_held", F.count("*").over(Window.partitionBy("item_id"))), "overlap-ranks")

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(d.select("doc_id", "of_doc"), "doc_id").join(i.select("item_id", "words"), "item_id")
        return both.select("doc_id", "item_id", "n_model", F.size(F.array_intersect("of_doc", "words")).alias("n_common"))

    first = held.join(ranked.where(F.col("rank") <= FIRST_WORDS), "word").groupBy("item_id", "n_model", "doc_id").agg(F.count("*").alias("hits"))
    few = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))
    least = compared(first.withColumn("no", few).where(F.col("no") <= FIRST_DOCS)).groupBy("item_id").agg(F.max("n_common").alias("least"))
    prefix = ranked.join(least, "item_id").where(F.col("rank") <= F.col("n_held") - F.col("least") + 1)
    met = held.join(prefix, "word").where(F.col("n_doc") >= F.col("least")).select("item_id", "n_model", "doc_id").distinct()
    return compared(met)


def best_overlap(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each of ``items(item_id, text)`` the row of ``docs(doc_id, text)`` with the best overlap (ties: smallest id)."""
    common = overlap_candidates(docs, items)
    best = common.groupBy("item_id", "n_model").agg(F.max(F.struct("n_common", (-F.col("doc_id")).alias("back"))).alias("b"))
    score = F.col("b.n_common") / F.col("n_model")
    return best.select("item_id", (-F.col("b.back")).alias("doc_id"), F.col("b.n_common").cast("long").alias("n_common"), F.round(score, 6).alias("overlap"), F.round(score * 10, 4).alias("marks"))


def words_of(c: Column) -> Column:
    """The vectoriser's tokens: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def tfidf_cosine(pairs: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """pair_id, tfidf: cosine of the two texts of ``pairs(pair_id, student, model)`` in their own two-text corpus; 0.0 if none."""
    each = pairs.select("pair_id", F.explode(words_of(F.col("student"))).alias("term"), F.lit(1).alias("s"), F.lit(0).alias("m"))
    each = each.union(pairs.select("pair_id", F.explode(words_of(F.col("model"))), F.lit(0), F.lit(1)))
    if stop:
        each = each.where(~F.col("term").isin(stop))
    tf = each.groupBy("pair_id", "term").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    df = (F.col("s") > 0).cast("int") + (F.col("m") > 0).cast("int")
    idf = F.log(3.0 / (1 + df)) + 1
    tf = tf.select("pair_id", (F.col("s") * idf).alias("s"), (F.col("m") * idf).alias("m"))
    sums = tf.groupBy("pair_id").agg(F.sum(F.col("s") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("s") ** 2)).alias("ns"), F.sqrt(F.sum(F.col("m") ** 2)).alias("nm"))
    cosine = F.when((F.col("ns") > 0) & (F.col("nm") > 0), F.col("dot") / F.col("ns") / F.col("nm")).otherwise(0.0)
    return pairs.select("pair_id").join(sums.select("pair_id", cosine.alias("tfidf")), "pair_id", "left").select("pair_id", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def top_terms(texts: DataFrame, most: int = 15, stop: list[str] | None = None) -> DataFrame:
    """pair_id, term of the ``most`` frequent words and word pairs of ``texts(pair_id, model)``; ties by alphabet."""
    w = F.filter(words_of(F.col("model")), lambda t: ~t.isin(stop or ENGLISH_STOP))
    own = texts.select("pair_id", w.alias("w"))
    pairs = F.zip_with(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    grams = own.select("pair_id", F.explode(F.concat("w", pairs)).alias("term"))
    counts = grams.groupBy("pair_id", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("pair_id", "term")


def keyword_lists(texts: DataFrame, **how) -> DataFrame:
    """pair_id, keywords: the top terms in alphabetical order."""
    return top_terms(texts, **how).groupBy("pair_id").agg(F.array_sort(F.collect_list("term")).alias("keywords"))


def missing_keywords(pairs: DataFrame) -> DataFrame:
    """pair_id, keywords and those that are no token of the student's text; a word pair is never one."""
    k = pairs.join(keyword_lists(pairs), "pair_id")
    return k.select("pair_id", "keywords", F.array_except("keywords", tokens(F.col("student"))).alias("missing"))


def hybrid_score(pairs: DataFrame) -> DataFrame:
    """pair_id, tfidf, keyword, final, marks: 0.6 * cosine + 0.4 * share of keyword words found, at most 1."""
    k = pairs.join(keyword_lists(pairs), "pair_id", "left")
    # keyword pairs fall apart into words here
    words = F.split(F.array_join("keywords", " "), " ")
    hit = let(tokens(F.col("student")), lambda own: F.size(F.filter(words, lambda w: F.array_contains(own, w))))
    share = F.when(F.col("keywords").isNull(), 0.0).otherwise(hit / F.size(words))
    both = k.select("pair_id", share.alias("keyword")).join(tfidf_cosine(pairs, ENGLISH_STOP), "pair_id")
    final = F.least(F.lit(1.0), 0.6 * F.col("tfidf") + 0.4 * F.col("keyword"))
    return both.select("pair_id", F.round("tfidf", 6).alias("tfidf"), F.round("keyword", 6).alias("keyword"), F.round(final, 6).alias("final"), F.round(final * 10, 5).alias("marks"))


def fuzzy_coverage(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """pair_id, n_keywords, n_matched, score: keyword words with a student's word at the ratio or above."""
    k = keyword_lists(pairs).select("pair_id", F.explode(F.array_distinct(F.split(F.array_join("keywords", " "), " "))).alias("keyword"))
    s = pairs.select("pair_id", F.explode(F.array_distinct(tokens(F.col("student")))).alias("word"))
    near = candidate_pairs(s.where("word != ''"), k.withColumnRenamed("keyword", "term"), ["pair_id"], threshold)
    # a word's ratio to a keyword is the same in every pair
    rated = near.select("word", "term").distinct().where(sequence_ratio(F.col("word"), F.col("term")) >= threshold)
    hits = near.join(rated, ["word", "term"], "left_semi").select("pair_id", F.col("term").alias("keyword")).distinct().withColumn("hit", F.lit(1))
    out = k.join(hits, ["pair_id", "keyword"], "left").groupBy("pair_id").agg(F.count("*").alias("n_keywords"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_matched"))
    return out.withColumn("score", F.round(F.col("n_matched") / F.col("n_keywords"), 6))
