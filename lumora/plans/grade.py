"""Grading of whole exams: alignment, scores, winners, totals, and the report. One job for any number of exams and students."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.text import natural_key
from lumora.operators import align, similarity
from lumora.plans.stages import Stages


def grade(models: DataFrame, students: DataFrame, rubric: DataFrame, exams: DataFrame, encoder=similarity.lexical_encoder, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """(breakdown, results) for models(exam_id, q_key, text), students(exam_id, student_id, q_key, ord, text),
    rubric(exam_id, q_key, max_marks, q_type, group_id) and exams(exam_id, total_marks).

    With ``stages`` each written step is counted and timed; ``stages.table()`` has them. An answer without a text, a key of no
    exam and a score without feedback count as errors of their stage.
    """
    cut = (stages or Stages(models.sparkSession)).cut
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    models, students, exams = cut(models, "models", blank), cut(students, "students", blank), cut(exams, "exams", F.col("total_marks").isNull())
    rubric = cut(align.usable_rubric(rubric, exams), "rubric", F.col("max_marks").isNull())
    info = align.resolved(models, rubric, align.default_marks(models, rubric, exams))
    one = ["exam_id", "student_id"]
    aligned = cut(align.align_keys(models, students), "alignment")
    taken = aligned.where("how != 'part'").select(*one, "m_key", "s_key", F.lit("").alias("note"))
    parts = align.joined_parts(aligned, students)
    used = aligned.select(*one, "m_key", "s_key")
    # what is left on both sides, by similarity of the whole texts
    people = students.select(*one).distinct()
    open_m = align.not_attempted(models, people, used).join(models.select("exam_id", F.col("q_key").alias("m_key"), F.col("text").alias("m_text")), ["exam_id", "m_key"])
    open_s = students.join(used.select(*one, F.col("s_key").alias("q_key")), [*one, "q_key"], "left_anti").where(F.length(F.trim("text")) >= 10).select(*one, F.col("q_key").alias("s_key"), "ord", F.col("text").alias("s_text"))
    asks = open_m.where("m_text is not null").groupBy(*one).agg(F.collect_list(F.struct("m_key", "m_text")).alias("m"))
    offers = open_s.groupBy(*one).agg(F.collect_list(F.struct("s_key", "ord", "s_text")).alias("s"))
    both = asks.join(offers, one).withColumn("all", similarity.cosines(encoder, F.col("m.m_text"), F.col("s.s_text")))
    # the texts stay behind: only keys go on to the pairs
    pairs = both.select(*one, F.col("s.s_key").alias("s_keys"), F.col("s.ord").alias("ords"), F.explode(F.arrays_zip(F.col("m.m_key").alias("m_key"), F.col("all").alias("each"))).alias("x"))
    pairs = pairs.select(*one, "x.m_key", F.explode(F.arrays_zip(F.col("s_keys").alias("s_key"), F.col("ords").alias("ord"), F.col("x.each").alias("similarity"))).alias("y"))
    greedy = align.align_greedy(pairs.select(*one, "m_key", "y.s_key", "y.ord", "y.similarity"))
    direct = taken.union(greedy.withColumn("note", F.concat(F.lit(" (matched to Q"), "s_key", F.lit(")"))))
    answers = direct.join(students.select(*one, F.col("q_key").alias("s_key"), "text"), [*one, "s_key"]).select(*one, "m_key", "text", "note")
    joined = parts.select(*one, "m_key", "text", F.concat(F.lit(" (aggregated from student Q"), F.array_join("s_keys", ", Q"), F.lit(")")).alias("note"))
    answers = answers.union(joined).join(models.select("exam_id", F.col("q_key").alias("m_key"), F.col("text").alias("model")), ["exam_id", "m_key"])
    answers = cut(answers, "answers", blank | (F.coalesce(F.trim("model"), F.lit("")) == "")).withColumn("answer_id", F.concat_ws("\u0001", F.col("exam_id").cast("string"), F.col("student_id").cast("string"), "m_key"))
    scored = similarity.score_answers(answers.select("answer_id", F.col("text").alias("student"), "model"), encoder)
    got = answers.select(*one, "m_key", "note", "answer_id").join(scored, "answer_id").drop("answer_id")
    rows = info.drop("text").withColumnRenamed("q_key", "m_key").join(people, "exam_id").join(got, [*one, "m_key"], "left")
    rows = rows.select(*one, F.col("m_key").alias("q_key"), "base_key", "group_id", "q_type", "max_marks", F.coalesce(align.to_marks(F.col("score"), F.col("max_marks")), F.lit(0.0)).alias("score"), F.when(F.col("feedback").isNull(), "Not Attempted").otherwise(F.concat("feedback", "note")).alias("feedback"), "details")
    rows = align.with_winners(cut(rows, "scores", F.col("feedback") == "Not Attempted"))
    rows = rows.withColumn("feedback", F.when(F.col("selected"), F.col("feedback")).otherwise(F.concat("feedback", F.lit(" (OR alternative -- not counted)"))))
    return align.rescaled_rows(rows, exams), align.exam_totals(rows, exams)


def timed_grade(models: DataFrame, students: DataFrame, rubric: DataFrame, exams: DataFrame, encoder=similarity.lexical_encoder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As grade, with the table of its stages: no, stage, rows, errors, seconds, status, message."""
    stages = Stages(models.sparkSession)
    with stages:
        breakdown, results = grade(models, students, rubric, exams, encoder, stages)
        breakdown, results = stages.cut(breakdown, "breakdown"), stages.cut(results, "results")
    return breakdown, results, stages.table()


def color(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "green").when(ratio >= 0.5, "amber").otherwise("red")


def report(rows: DataFrame) -> DataFrame:
    """exam_id, student_id, q_key, num, part, percent, color, badge for scored rows; no marks to get make a ratio of 0."""
    ratio = F.when(F.col("max_marks") > 0, F.col("score") / F.col("max_marks")).otherwise(0.0)
    badge = F.when(F.col("q_type") == "challenge", "challenge").when(~F.col("selected"), "not counted").when(F.col("q_type") == "optional", "chosen").otherwise("")
    key = natural_key(F.col("q_key"))
    return rows.select("exam_id", "student_id", "q_key", key["num"].alias("num"), key["part"].alias("part"), F.round(ratio * 100, 4).alias("percent"), color(ratio).alias("color"), badge.alias("badge"))
