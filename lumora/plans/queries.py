"""The queries of the grading operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions import fuzzy
from lumora.functions import text as tf
from lumora.operators import align, lexical, paper, scan, segment, similarity
from lumora.plans import grade
from lumora.sources import files
from lumora.sources import tables as t

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "documents")


def _text(column, name):
    return lambda spark, d: _docs(spark, d).select("doc_id", column(F.col("text")).alias(name))


def _ocr_choice(spark, d):
    other = F.regexp_replace("text", "[a-z]{6,}", "#")
    chosen = tf.choose_engine(F.col("text"), other)
    return _docs(spark, d).select("doc_id", tf.readable_words(F.col("text")).alias("n_a"), tf.readable_words(other).alias("n_b"), F.length(chosen).alias("n_chars"))


def _word_windows(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tf.word_windows(F.col("text"))).alias("w_no", "w"))


def _fuzzy_positional(spark, d):
    """Pairs of distinct benchmark keywords; blocked on the first character and the length."""
    k = t.read(spark, d, "benchmark").select(F.explode(tf.keywords(F.col("text"))).alias("w")).distinct()
    a = k.select(F.col("w").alias("target"), F.left("w", F.lit(1)).alias("c"), F.explode(F.sequence(F.length("w") - 2, F.length("w") + 2)).alias("n"))
    b = k.select(F.col("w").alias("word"), F.left("w", F.lit(1)).alias("c"), F.length("w").alias("n"))
    return a.join(b, ["c", "n"]).where("target != word").where(tf.fuzzy_equal(F.col("target"), F.col("word"))).select("target", "word")


def _best_overlap(spark, d):
    return lexical.best_overlap(_docs(spark, d), t.read(spark, d, "benchmark"))


def _overlap_pairs(spark, d):
    return t.dialogue_pairs(spark, d).select("pair_id", F.round(lexical.overlap(F.col("student"), F.col("model")), 6).alias("overlap"))


def _tfidf(spark, d):
    return lexical.tfidf_cosine(t.dialogue_pairs(spark, d)).select("pair_id", F.round("tfidf", 6).alias("tfidf"))


def _keywords(spark, d):
    return lexical.keyword_lists(t.dialogue_pairs(spark, d)).select("pair_id", F.array_join("keywords", "|").alias("keywords"))


def _missing(spark, d):
    return lexical.missing_keywords(t.dialogue_pairs(spark, d)).select("pair_id", F.array_join("missing", "|").alias("missing"))


def _vectors(spark, d):
    return t.read(spark, d, "embeddings").withColumn("exam", F.floor(F.col("vec_id") / 40))


def _semantic_top1(spark, d):
    e = _vectors(spark, d)
    q = e.where("vec_id % 2 = 1").select(F.col("exam").alias("answer_id"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    w = e.where("vec_id % 2 = 0").select(F.col("exam").alias("answer_id"), F.col("vec_id").alias("window_id"), F.col("embedding").alias("vector"))
    return similarity.best_windows(q, w).select("query_id", "window_id", F.round("similarity", 6).alias("similarity"))


def _semantic_topk(spark, d):
    """The three vectors of each label that are most similar to the label's sum."""
    e = t.read(spark, d, "embeddings")
    sums = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    centre = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    s = e.join(centre, "label").withColumn("similarity", F.round(similarity.cosine(F.col("embedding"), F.col("centre")), 6))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))
    return s.withColumn("rank", rank).where("rank <= 3").select("label", "rank", "vec_id", "similarity")


def _ngrams(spark, d):
    return t.read(spark, d, "benchmark").select("item_id", F.explode(similarity.candidate_ngrams(F.col("text"))).alias("ngram"))


def _scored_vectors(spark, d):
    p = t.vector_pairs(spark, d).withColumn("noisy", F.col("pair_id") % 3 == 0).withColumn("coverage", (F.col("pair_id") % 9) / 8.0)
    p = p.withColumn("hits", F.col("pair_id") % 4).withColumn("n_words", F.col("pair_id") % 12)
    p = p.withColumn("base", F.round(tf.semantic_base(F.col("similarity"), F.col("noisy")), 6))
    return p.withColumn("final", F.round(tf.final_score(F.col("similarity"), F.col("noisy"), F.col("coverage"), F.col("hits"), F.col("n_words")), 6))


def _feedback(spark, d):
    p = _scored_vectors(spark, d)
    missing = F.when(p["coverage"] < 1, F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))).otherwise(F.array().cast("array<string>"))
    return p.select("pair_id", F.bround(F.col("final") * 10, 1).alias("score"), tf.feedback(F.col("final"), missing).alias("feedback"))


def _usable(spark, d):
    return align.usable_rubric(t.exam_rubric(spark, d), t.exams(spark, d))


def _default_marks(spark, d):
    return align.default_marks(t.exam_models(spark, d), _usable(spark, d), t.exams(spark, d))


def _resolved(spark, d):
    return align.resolved(t.exam_models(spark, d), _usable(spark, d), _default_marks(spark, d))


def _aligned(spark, d):
    return align.align_keys(t.model_rows(spark, d), t.student_rows(spark, d), t.parts(spark, d))


def _parts(spark, d):
    return align.joined_parts(_aligned(spark, d), t.exam_students(spark, d), t.parts(spark, d)).select("exam_id", "student_id", "m_key", F.array_join("s_keys", ",").alias("s_keys"), "text")


def _missed(spark, d):
    return align.not_attempted(t.exam_models(spark, d), t.dealt(t.student_rows(spark, d), spark, d), _aligned(spark, d), t.parts(spark, d))


def _winners(spark, d):
    return align.with_winners(t.exam_scores(spark, d)).select("exam_id", "student_id", "q_key", "group_id", "score", "selected")


def _totals(spark, d):
    return align.exam_totals(align.with_winners(t.exam_scores(spark, d)), t.exams(spark, d))


def _rescaled(spark, d):
    rows = align.rescaled_rows(align.with_winners(t.exam_scores(spark, d)), t.exams(spark, d))
    return rows.select("exam_id", "student_id", "q_key", F.round("score", 4).alias("score"), "max_marks", "selected")


def _report(spark, d):
    return grade.report(align.with_winners(t.exam_scores(spark, d)))


def _natural(spark, d):
    m = t.exam_models(spark, d)
    rank = F.row_number().over(Window.partitionBy("exam_id").orderBy(tf.natural_key(F.col("q_key"))))
    return m.select("exam_id", "q_key", rank.alias("place"))


def _bench_models(spark, d):
    return t.read(spark, d, "benchmark").select((F.col("item_id") % 5).alias("exam_id"), (F.col("item_id") % 50 + 1).cast("string").alias("q_key"), "item_id", "text")


def _vocabulary(spark, d):
    return align.vocabulary(_bench_models(spark, d))


def _segments(spark, d):
    return segment.segment(t.numbered_texts(spark, d)).select("doc_id", "q_key", "num", "part", "text")


def _guard(spark, d):
    p = segment.pieces(t.numbered_texts(spark, d))
    return p.select("doc_id", "key_raw", "num", "guarded", "parent", F.length("content").alias("n_chars"))


def _subparts(spark, d):
    p = segment.pieces(t.numbered_texts(spark, d))
    intro, parts = segment.parts_of(F.col("content"))
    return p.select("doc_id", "key_raw", intro.alias("intro"), F.explode(parts).alias("x")).select("doc_id", "key_raw", "intro", "x.letter", "x.text")


def _merged(spark, d):
    return segment.merged(segment.written_pieces(t.numbered_texts(spark, d))).select("doc_id", "q_key", "text")


def _expected(spark, d):
    texts = t.numbered_texts(spark, d)
    keys = texts.select("doc_id", F.array(*[F.lit(k) for k in ("1", "2", "2a", "6", "6a", "6b", "7", "12", "13", "14", "_total_marks")]).alias("q_keys"))
    return segment.segment_with_fallback(texts, keys).select("doc_id", "q_key", "num", "part", "text")


def _chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(segment.chunks(F.coalesce("text", F.lit("")), F.lit(3))).alias("no", "chunk")).select("doc_id", "no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def _pages(spark, d):
    """Scanned files, joined with the page mark and split again."""
    whole = scan.page_concat(t.scanned_pages(spark, d))
    return whole.select("doc_id", F.posexplode(segment.pages(F.col("text"))).alias("page_no", "page")).select("doc_id", "page_no", F.md5("page").alias("digest"))


def _headers_off(spark, d):
    kept = segment.lines_without_headers(F.col("text"))
    return t.headed_texts(spark, d).select("doc_id", kept.alias("kept")).select("doc_id", F.length("kept").alias("n_chars"), F.md5("kept").alias("digest"))


def _pages_by_header(spark, d):
    p = t.headed_texts(spark, d).select("doc_id", F.posexplode(segment.pages(F.col("text"))).alias("page_no", "page"))
    return p.select("doc_id", "page_no", F.length("page").alias("n_chars"), F.md5("page").alias("digest"))


def _short_list(spark, d):
    """Benchmark texts with every "th" turned round, corrected by the ten most frequent longer words of the benchmark."""
    b = t.read(spark, d, "benchmark").select(F.col("item_id").alias("text_id"), tf.clean_text(F.col("text")).alias("text"))
    top = b.select(F.explode(tf.tokens(F.col("text"))).alias("w")).where(F.length("w") > 3).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(10)
    return fuzzy.correct_by_list(b.withColumn("text", F.replace("text", F.lit("th"), F.lit("ht"))), [r.w for r in top.collect()])


def _page_concat(spark, d):
    return scan.page_concat(t.scanned_pages(spark, d)).select("doc_id", "n_pages", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _preamble(spark, d):
    """Question 1 of each sheet after what stands before the first marker has been added."""
    return segment.segment(t.numbered_texts(spark, d)).where("q_key = '1'").select("doc_id", "text")


def _paper_rows(spark, d):
    return paper.question_rows(t.papers(spark, d))


def _or_groups(spark, d):
    p = t.papers(spark, d)
    return paper.or_groups(paper.question_rows(p), p)


def _challenge(spark, d):
    p = t.papers(spark, d)
    return paper.challenge_numbers(paper.question_rows(p), p)


def _paper_schema(spark, d):
    """Which papers give a rubric, only a total, or nothing; and whether it has two-part questions 7 to 9."""
    return paper.schema_state(t.papers(spark, d))


def _line_grep(spark, d):
    lines = paper.paper_lines(t.papers(spark, d))
    return lines.where(F.rlike("line", F.lit(r"(?i)(CO\s*4|PART\s*[AB]|max)"))).select("exam_id", "line_no", "line")


def _answer_scores(spark, d):
    """Scored answers of the dialogue pairs, by the lexical encoder."""
    pairs = t.dialogue_pairs(spark, d).withColumnRenamed("pair_id", "answer_id")
    s = similarity.score_answers(pairs)
    return s.select("answer_id", "score", "feedback", F.col("details.similarity").alias("similarity"), F.col("details.concept_coverage").alias("coverage"))


def _latest(spark, d):
    """The latest event of each user: the job status of a submission. Ties go to the larger id."""
    e = t.read(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"), F.count("*").alias("n_events"))
    return last.select("user_id", "x.event_id", F.col("x.event_type").alias("status"), "x.value", "n_events")


def _jobs(spark, d):
    """The state of every job by the rules of the job store."""
    j = files.job_states(t.job_changes(spark, d))
    return j.select("job_id", "step", "status", "message", "changes", "ignored", "percent")


def _stage_rows(spark, d):
    """Rows and errors of each stage of grading a whole exam."""
    return grade.timed_grade(*_grade_tables(spark, d))[2].where("stage != 'total'").select("no", "stage", "rows", "errors", "status")


def _profile(spark, d):
    s = _segments(spark, d)
    return s.select("doc_id", "q_key", F.length("text").alias("n_chars"), F.translate(F.substring("text", 1, 60), "\n", " ").alias("preview"))


def _page_count(spark, d):
    return t.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n_pages"))


def _alignment(spark, d):
    return align.key_alignment(t.model_rows(spark, d), t.student_rows(spark, d), t.parts(spark, d))


def _expected_union(spark, d):
    return align.expected_keys(t.model_rows(spark, d), t.rubric_rows(spark, d), t.parts(spark, d))


def _label_agreement(spark, d):
    """Quality labels against the noise rule: how many texts of each label are noisy."""
    n = _docs(spark, d).select("doc_id", (tf.noise_ratio(F.col("text")) > 0.30).alias("noisy"))
    return n.join(t.read(spark, d, "labels"), "doc_id").groupBy("quality", "noisy").agg(F.count("*").alias("n"))


def _term_recovery(spark, d):
    """Which of an item's keywords stand in the document with its best overlap."""
    b, docs = t.read(spark, d, "benchmark"), _docs(spark, d)
    best = _best_overlap(spark, d).select("item_id", "doc_id")
    x = b.select("item_id", F.array_distinct(tf.keywords(F.col("text"))).alias("terms")).join(best, "item_id").join(docs.select("doc_id", F.lower("text").alias("body")), "doc_id")
    hit = F.filter("terms", lambda k: F.contains(F.col("body"), k))
    return x.select("item_id", "doc_id", F.size("terms").alias("n_terms"), F.size(hit).alias("n_found"))


def _misspelt(spark, d):
    """Benchmark texts with every "th" turned round, against the vocabulary of the right ones."""
    m = _bench_models(spark, d)
    return m.select("exam_id", F.col("item_id").alias("answer_id"), F.replace(tf.clean_text(F.col("text")), F.lit("th"), F.lit("ht")).alias("text"))


def _spell(spark, d):
    return fuzzy.correct_spelling(_misspelt(spark, d), _vocabulary(spark, d))


def _fuzzy_cover(spark, d):
    return lexical.fuzzy_coverage(t.dialogue_pairs(spark, d))


def _greedy(spark, d):
    """Odd vectors as model keys and even ones as student rows of small exams."""
    e = _vectors(spark, d)
    m = e.where("vec_id % 2 = 1").select("exam", F.col("vec_id").cast("string").alias("m_key"), F.col("embedding").alias("a"))
    s = e.where("vec_id % 2 = 0").select("exam", F.col("vec_id").cast("string").alias("s_key"), F.col("vec_id").alias("ord"), F.col("embedding").alias("b"))
    p = m.join(s, "exam").select(F.col("exam").alias("exam_id"), F.lit(1).alias("student_id"), "m_key", "s_key", "ord", similarity.cosine(F.col("a"), F.col("b")).alias("similarity"))
    return align.align_greedy(p)


def _grade_tables(spark, d):
    """Sheets of numbered texts as students of an exam, whose model answers are a conversation's replies."""
    texts = segment.segment(t.numbered_texts(spark, d))
    c = t.read(spark, d, "conversations").where("role = 'assistant'")
    models = c.groupBy(F.col("conv_id").alias("exam_id"), ((F.col("turn") * 5) % 9 + 1).cast("string").alias("q_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text")))), lambda x: x["text"]), " ").alias("text"))
    students = texts.select(F.col("doc_id").alias("exam_id"), F.lit(1).alias("student_id"), "q_key", "ord", "text")
    exams = models.groupBy("exam_id").agg(F.lit(50).alias("total_marks"))
    rubric = models.select("exam_id", "q_key", F.lit(5).alias("max_marks"), F.lit("mandatory").alias("q_type"), F.col("q_key").alias("group_id")).where("q_key = '1'")
    return models, students, rubric, exams


def _grade(spark, d):
    return grade.grade(*_grade_tables(spark, d))[0].select("exam_id", "student_id", "q_key", "score", "max_marks", "selected", "feedback")


def _grade_results(spark, d):
    return grade.grade(*_grade_tables(spark, d))[1]


QUERIES = {
    "clean_text": _text(tf.clean_text, "cleaned"),
    "clean_text_strict": _text(tf.clean_strict, "cleaned"),
    "clean_ocr_alpha": _text(tf.clean_alpha, "cleaned"),
    "tokenize_count": _text(lambda c: F.size(tf.tokens(c)), "n_tokens"),
    "keywords_simple": _text(lambda c: F.array_join(tf.keywords(c), " "), "keywords"),
    "noise_ratio": _text(lambda c: F.round(tf.noise_ratio(c), 6), "noise"),
    "readable_words": _text(tf.readable_words, "n_words"),
    "ocr_choice": _ocr_choice,
    "word_windows": _word_windows,
    "fuzzy_positional": _fuzzy_positional,
    "overlap_best": _best_overlap,
    "overlap_pairs": _overlap_pairs,
    "tfidf_cosine": _tfidf,
    "tfidf_keywords": _keywords,
    "missing_keywords": _missing,
    "hybrid_score": lambda spark, d: lexical.hybrid_score(t.dialogue_pairs(spark, d)),
    "vector_cosine": t.vector_pairs,
    "semantic_top1": _semantic_top1,
    "semantic_topk_per_label": _semantic_topk,
    "ngram_candidates": _ngrams,
    "semantic_band": lambda spark, d: _scored_vectors(spark, d).select("pair_id", "similarity", "base"),
    "blend_floor": lambda spark, d: _scored_vectors(spark, d).select("pair_id", "final"),
    "feedback_tier": _feedback,
    "garbage_schema": _usable,
    "default_marks": _default_marks,
    "rubric_resolve": _resolved,
    "align_exact": lambda spark, d: _aligned(spark, d).where("how = 'exact'").drop("how"),
    "align_base": lambda spark, d: _aligned(spark, d).where("how = 'base'").drop("how"),
    "align_subparts": _parts,
    "not_attempted": _missed,
    "or_winner": _winners,
    "exam_totals": _totals,
    "rescale_totals": _rescaled,
    "report_rows": _report,
    "natural_sort": _natural,
    "vocabulary": _vocabulary,
    "expected_union": _expected_union,
    "key_alignment": _alignment,
    "segment_questions": _segments,
    "monotonic_guard": _guard,
    "segment_subparts": _subparts,
    "merge_keys": _merged,
    "segment_expected": _expected,
    "chunk_paragraphs": _chunks,
    "header_strip": _headers_off,
    "page_headers": _pages_by_header,
    "page_concat": _page_concat,
    "page_split": _pages,
    "preamble_rescue": _preamble,
    "paper_rows": _paper_rows,
    "total_marks": lambda spark, d: paper.total_marks(t.papers(spark, d)),
    "or_groups": _or_groups,
    "challenge_type": _challenge,
    "paper_rubric": lambda spark, d: paper.rubric(t.papers(spark, d)),
    "paper_schema": _paper_schema,
    "line_grep": _line_grep,
    "latest_per_status": _latest,
    "job_progress": _jobs,
    "grade_stages": _stage_rows,
    "marker_kwic": lambda spark, d: segment.marker_context(t.numbered_texts(spark, d)),
    "segment_profile": _profile,
    "page_count": _page_count,
    "label_agreement": _label_agreement,
    "term_recovery": _term_recovery,
    "spell_correct": _spell,
    "spell_short_list": _short_list,
    "fuzzy_keyword_cover": _fuzzy_cover,
    "greedy_semantic": _greedy,
    "answer_scores": _answer_scores,
    "grade_rows": _grade,
    "grade_totals": _grade_results,
}
