"""Alignment of model and student answers, and the totals of exams. Everything is keyed by exam (and student): equi-joins,
windows of one exam's few rows, and one fold for the greedy assignment, which is sequential by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.text import base_number, natural_key


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt to so many partitions by all keys of the join that follows, which then needs no exchange of its own."""
    return rows.repartition(parts, *keys) if parts else rows


def usable_rubric(rubric: DataFrame, exams: DataFrame) -> DataFrame:
    """The rows of ``rubric(exam_id, q_key, max_marks, q_type, group_id)`` but those of exams whose rubric is garbage.

    Garbage: a number above 50, or no more than two keys that hold all of the exam's total marks.
    """
    r = rubric.join(exams.select("exam_id", "total_marks"), "exam_id", "left")
    per = r.groupBy("exam_id").agg(
        F.bool_or(F.coalesce(base_number(F.col("q_key")).try_cast("int") > 50, F.lit(False))).alias("wild"),
        F.count("*").alias("n"), F.sum("max_marks").alias("marks"), F.max("total_marks").alias("total"))
    bad = per.where(F.col("wild") | (F.coalesce(F.col("total"), F.lit(0)).cast("boolean") & (F.col("n") <= 2) & (F.col("marks") >= F.col("total")))).select("exam_id")
    return rubric.join(bad, "exam_id", "left_anti")


def default_marks(models: DataFrame, rubric: DataFrame, exams: DataFrame) -> DataFrame:
    """exam_id, default_marks: total / distinct groups of the rubric (else / model keys), rounded, at least 1; 5 without a total."""
    keys = models.groupBy("exam_id").agg(F.count_distinct("q_key").alias("n_keys"))
    groups = rubric.groupBy("exam_id").agg(F.count_distinct("group_id").alias("n_groups"))
    e = keys.join(exams.select("exam_id", "total_marks"), "exam_id", "left").join(groups, "exam_id", "left")
    share = F.bround(F.col("total_marks") / F.coalesce("n_groups", "n_keys"), 0).cast("int")
    return e.select("exam_id", F.when(F.coalesce(F.col("total_marks"), F.lit(0)) == 0, 5).otherwise(F.greatest(F.lit(1), share)).alias("default_marks"))


def resolved(models: DataFrame, rubric: DataFrame, defaults: DataFrame) -> DataFrame:
    """``models(exam_id, q_key, ...)`` with base_key, max_marks, group_id, q_type: the key's rubric, else its number's, else defaults."""
    r = rubric.select("exam_id", "q_key", F.struct("max_marks", "group_id", "q_type").alias("own"))
    m = models.withColumn("base_key", base_number(F.col("q_key"))).join(r, ["exam_id", "q_key"], "left")
    m = m.join(r.select("exam_id", F.col("q_key").alias("base_key"), F.col("own").alias("of_base")), ["exam_id", "base_key"], "left")
    m = m.withColumn("r", F.coalesce("own", "of_base")).join(defaults, "exam_id", "left")
    return m.select(*models.columns, "base_key", F.coalesce("r.max_marks", "default_marks").alias("max_marks"), F.coalesce("r.group_id", "q_key").alias("group_id"), F.coalesce("r.q_type", F.lit("mandatory")).alias("q_type"))


def align_exact(models: DataFrame, students: DataFrame) -> DataFrame:
    """exam_id, student_id, m_key, s_key for equal keys. ``models(exam_id, q_key)``, ``students(exam_id, student_id, q_key)``."""
    s = students.select("exam_id", "student_id", F.col("q_key").alias("s_key"))
    m = models.select("exam_id", F.col("q_key").alias("m_key"))
    return s.join(m.withColumn("s_key", F.col("m_key")), ["exam_id", "s_key"]).select("exam_id", "student_id", "m_key", "s_key")


def align_base(models: DataFrame, students: DataFrame) -> DataFrame:
    """As align_exact, for model parts without a row of their own: the first part (by string order) takes the student's number.

    A student row that an equal key has taken is not available, and each is used once.
    """
    exact = align_exact(models, students)
    free_s = students.select("exam_id", "student_id", F.col("q_key").alias("s_key")).join(exact.select("exam_id", "student_id", "s_key"), ["exam_id", "student_id", "s_key"], "left_anti")
    asked = models.select("exam_id", F.col("q_key").alias("m_key"), base_number(F.col("q_key")).alias("s_key")).where("m_key != s_key")
    p = free_s.join(asked, ["exam_id", "s_key"]).join(exact.select("exam_id", "student_id", "m_key"), ["exam_id", "student_id", "m_key"], "left_anti")
    first = F.row_number().over(Window.partitionBy("exam_id", "student_id", "s_key").orderBy("m_key"))
    return p.withColumn("no", first).where("no = 1").select("exam_id", "student_id", "m_key", "s_key")


def align_parts(models: DataFrame, students: DataFrame, taken: DataFrame) -> DataFrame:
    """exam_id, student_id, m_key, s_keys, text: a plain model number gets all free parts of the student, sorted and joined.

    ``students`` has text; ``taken(exam_id, student_id, m_key, s_key)`` are the matches so far.
    """
    key = natural_key(F.col("q_key"))
    s = students.where(key["part"] != "").join(taken.select("exam_id", "student_id", F.col("s_key").alias("q_key")), ["exam_id", "student_id", "q_key"], "left_anti")
    s = s.select("exam_id", "student_id", F.col("q_key").alias("s_key"), "text", key["num"].alias("num"))
    m = models.where(key["part"] == "").select("exam_id", F.col("q_key").alias("m_key"), key["num"].alias("num"))
    p = s.join(m, ["exam_id", "num"]).join(taken.select("exam_id", "student_id", "m_key"), ["exam_id", "student_id", "m_key"], "left_anti")
    g = p.groupBy("exam_id", "student_id", "m_key").agg(F.array_sort(F.collect_list(F.struct("s_key", "text"))).alias("x"))
    return g.select("exam_id", "student_id", "m_key", F.col("x.s_key").alias("s_keys"), F.array_join(F.col("x.text"), " ").alias("text"))


def align_keys(models: DataFrame, students: DataFrame, parts: int | None = None) -> DataFrame:
    """exam_id, student_id, m_key, s_key, how (exact, base, part): the rules of align_exact, align_base and align_parts in one join.

    All three only match keys of one number, so both sides meet on exam and number, and windows over the same partitions
    find out which keys are taken. A part match is a row for each part. Keys may repeat on both sides; ``parts`` are the
    partitions they are dealt to, else Spark's.
    """
    s = students.select("exam_id", "student_id", F.col("q_key").alias("s_key"), base_number(F.col("q_key")).alias("num"))
    m = models.select("exam_id", F.col("q_key").alias("m_key"), base_number(F.col("q_key")).alias("num"))
    p = _dealt(s, parts, "exam_id", "num").distinct().join(_dealt(m, parts, "exam_id", "num").distinct(), ["exam_id", "num"]).withColumn("exact", F.col("m_key") == F.col("s_key"))
    of = lambda *keys: Window.partitionBy("exam_id", "num", "student_id", *keys)
    p = p.withColumn("s_exact", F.max("exact").over(of("s_key"))).withColumn("m_exact", F.max("exact").over(of("m_key")))
    asks = (F.col("s_key") == F.col("num")) & ~F.col("s_exact") & ~F.col("m_exact")
    p = p.withColumn("base", asks & (F.col("m_key") == F.min(F.when(asks, F.col("m_key"))).over(of("s_key"))))
    taken = F.col("exact") | F.col("base")
    p = p.withColumn("s_taken", F.max(taken).over(of("s_key"))).withColumn("m_taken", F.max(taken).over(of("m_key")))
    plain = F.rlike("m_key", F.lit(r"^\d+$")) & (F.col("s_key") != F.col("num")) & F.startswith("s_key", F.col("m_key"))
    how = F.when(F.col("exact"), "exact").when(F.col("base"), "base").when(plain & ~F.col("s_taken") & ~F.col("m_taken"), "part")
    return p.select("exam_id", "student_id", "m_key", "s_key", how.alias("how")).where("how is not null")


def joined_parts(aligned: DataFrame, students: DataFrame, parts: int | None = None) -> DataFrame:
    """exam_id, student_id, m_key, s_keys, text: the parts of a plain number, sorted and joined."""
    texts = students.select("exam_id", "student_id", F.col("q_key").alias("s_key"), "text")
    deal = lambda rows: _dealt(rows, parts, "exam_id", "s_key")
    p = deal(aligned.where("how = 'part'")).join(deal(texts), ["exam_id", "student_id", "s_key"])
    g = p.groupBy("exam_id", "student_id", "m_key").agg(F.array_sort(F.collect_list(F.struct("s_key", "text"))).alias("x"))
    return g.select("exam_id", "student_id", "m_key", F.col("x.s_key").alias("s_keys"), F.array_join(F.col("x.text"), " ").alias("text"))


def align_greedy(similar: DataFrame, least: float = 0.2) -> DataFrame:
    """exam_id, student_id, m_key, s_key: model keys in string order take the most similar free student row above ``least``.

    ``similar(exam_id, student_id, m_key, s_key, ord, similarity)``: of equal similarities the first row by ``ord``. The rows
    of an exam and student, sorted as they are asked, are folded once; the state is the keys served and the rows in use.
    Similarities count to nine places.
    """
    row = F.struct("m_key", (-F.round("similarity", 9)).alias("far"), "ord", "s_key")
    sorted_ = similar.where(F.round("similarity", 9) > least).groupBy("exam_id", "student_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.array().cast("array<string>")

    def serve(taken: Column, x: Column) -> Column:
        done = F.array_contains(taken["m_keys"], x["m_key"]) | F.array_contains(taken["s_keys"], x["s_key"])
        more = F.struct(F.array_append(taken["m_keys"], x["m_key"]).alias("m_keys"), F.array_append(taken["s_keys"], x["s_key"]).alias("s_keys"))
        return F.when(done, taken).otherwise(more)

    taken = F.aggregate("rows", F.struct(none.alias("m_keys"), none.alias("s_keys")), serve)
    pairs = sorted_.withColumn("t", taken).select("exam_id", "student_id", F.explode(F.arrays_zip("t.m_keys", "t.s_keys")).alias("x"))
    return pairs.select("exam_id", "student_id", F.col("x.m_keys").alias("m_key"), F.col("x.s_keys").alias("s_key"))


def not_attempted(models: DataFrame, people: DataFrame, taken: DataFrame, parts: int | None = None) -> DataFrame:
    """exam_id, student_id, m_key for the model keys of an exam that a student of it has no match for.

    Keys asked and keys taken are grouped together: an anti join may be moved to where it is dealt out anew.
    """
    one = ["exam_id", "student_id", "m_key"]
    all_ = models.select("exam_id", F.col("q_key").alias("m_key")).join(people.select("exam_id", "student_id").distinct(), "exam_id")
    both = all_.select(*one, F.lit(True).alias("asked")).union(taken.select(*one, F.lit(False)))
    left = _dealt(both, parts, "exam_id").groupBy(*one).agg(F.bool_and("asked").alias("open"))
    return left.where("open").select(*one)


def to_marks(score: Column, max_marks: Column) -> Column:
    """Marks of a score of 0 to 10: rounded to a tenth after the score was."""
    return F.bround(F.bround(score, 1) / 10 * max_marks, 1)


def with_winners(scores: DataFrame) -> DataFrame:
    """``scores(exam_id, student_id, q_key, base_key, group_id, q_type, score, max_marks, ...)`` with ``selected``.

    Of each group the number with the highest sum of scores counts; of equal sums the first in string order of the keys.
    """
    one = ["exam_id", "student_id", "group_id"]
    sums = scores.groupBy(*one, "base_key").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.min("q_key").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*one).orderBy(F.desc(F.round("s", 6)), "first"))
    best = sums.withColumn("no", rank).where("no = 1").select(*one, F.col("base_key").alias("winner"))
    return scores.join(best, one).withColumn("selected", F.col("base_key") == F.col("winner")).drop("winner")


def exam_totals(selected: DataFrame, exams: DataFrame) -> DataFrame:
    """exam_id, student_id, obtained, possible, total_score, max_score: sums of what counts, rescaled to the paper's total."""
    counts = F.col("selected") & (F.col("q_type") != "challenge")
    t = selected.groupBy("exam_id", "student_id").agg(F.coalesce(F.sum(F.when(counts, F.col("score"))), F.lit(0.0)).alias("obtained"), F.coalesce(F.sum(F.when(counts, F.col("max_marks"))), F.lit(0)).alias("possible"))
    t = t.join(exams.select("exam_id", "total_marks"), "exam_id", "left")
    scaled = (F.coalesce("total_marks", F.lit(0)) > 0) & (F.col("possible") > 0) & (F.col("possible") != F.col("total_marks"))
    # rounded to six places first: sums of doubles come in any order
    return t.select("exam_id", "student_id", F.round("obtained", 6).alias("obtained"), "possible",
                    F.when(scaled, F.bround(F.round(F.col("obtained") * F.col("total_marks") / F.col("possible"), 6), 1)).otherwise(F.bround(F.round("obtained", 6), 1)).alias("total_score"),
                    F.when(scaled, F.col("total_marks")).otherwise(F.col("possible")).alias("max_score"))


def rescaled_rows(selected: DataFrame, exams: DataFrame) -> DataFrame:
    """The rows with score and max_marks scaled to the paper's total where the counted sum differs from it."""
    counts = F.col("selected") & (F.col("q_type") != "challenge")
    possible = F.sum(F.when(counts, F.col("max_marks")).otherwise(0)).over(Window.partitionBy("exam_id", "student_id"))
    s = selected.withColumn("possible", possible).join(exams.select("exam_id", "total_marks"), "exam_id", "left")
    factor = F.when((F.coalesce("total_marks", F.lit(0)) > 0) & (F.col("possible") > 0) & (F.col("possible") != F.col("total_marks")), F.col("total_marks") / F.col("possible"))
    return (s.withColumn("score", F.when(factor.isNull(), F.col("score")).otherwise(F.bround(F.round(F.col("score") * factor, 6), 1)))
            .withColumn("max_marks", F.when(factor.isNull(), F.col("max_marks")).otherwise(F.bround(F.round(F.col("max_marks") * factor, 6), 0).cast("int"))).drop("possible", "total_marks"))


def vocabulary(models: DataFrame) -> DataFrame:
    """exam_id, term: distinct tokens of the cleaned ``models(exam_id, text)``."""
    from lumora.functions.text import clean_text, tokens

    return models.select("exam_id", F.explode(tokens(clean_text(F.col("text")))).alias("term")).distinct()


def expected_keys(models: DataFrame, rubric: DataFrame, parts: int | None = None) -> DataFrame:
    """exam_id, q_key: keys of the model answers and of the rubric, without meta keys; ``parts`` are the partitions they are dealt to.

    Keys may repeat on both sides, so neither needs to be made distinct before.
    """
    keys = models.select("exam_id", "q_key").union(rubric.where(~F.startswith("q_key", F.lit("_"))).select("exam_id", "q_key"))
    return _dealt(keys, parts, "exam_id").distinct()


def key_alignment(models: DataFrame, students: DataFrame, parts: int | None = None) -> DataFrame:
    """exam_id, n_common, n_model_only, n_student_only, match_rate (of the model's keys). Keys may repeat on both sides."""
    side = lambda rows, m, s: rows.select("exam_id", "q_key", F.lit(m).alias("m"), F.lit(s).alias("s"))
    keys = side(models, True, False).union(side(students, False, True))
    j = _dealt(keys, parts, "exam_id").groupBy("exam_id", "q_key").agg(F.bool_or("m").alias("m"), F.bool_or("s").alias("s"))
    n = j.groupBy("exam_id").agg(F.count_if(F.col("m") & F.col("s")).alias("n_common"), F.count_if(~F.col("s")).alias("n_model_only"), F.count_if(~F.col("m")).alias("n_student_only"))
    total = F.col("n_common") + F.col("n_model_only")
    return n.withColumn("match_rate", F.round(F.when(total > 0, F.col("n_common") / total).otherwise(0.0), 6))
