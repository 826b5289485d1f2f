"""Question papers: marks rows, total marks, OR groups, challenge questions and the rubric, from paper text as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.text import base_number, strip

# Patterns of marks rows, marks in running text, totals, OR lines and challenge headings.
ROW = r"^\s*(\d{1,2})\s*[\.)\]]*\s*([a-z]?\s*[\)\}\]]*)?\s*[\|\[\(\/\\]*\s*(.*?)\s+(\d{1,2})\s*[I/l\|\s\\]*(?:(?:[Cc]+[Oo]+\s*\d|[Pp]+[Oo]+\s*\d)\s*)?$"
CLASSIC = r"(?is)(?:^|\n)\s*(?:Q|Question|Qn)?\s*\.?\s*(\d+[a-z]?)\s*[\.:\)\]\-\_]?\s*(.*?)(?:\[(\d+)\s*[Mm](?:arks)?\]|\((\d+)\s*[Mm](?:arks)?\)|[Mm]arks?\s*[\:\=\-]\s*(\d+)|(\d+)\s+[Mm]arks?)"
TOTALS = [
    r"(?i)(?:total|max(?:imum)?|full)\s*(?:marks?)\s*[:\=\-]?\s*(\d+)",
    r"(?i)(\d+)\s*(?:total)\s*marks?",
    r"(?i)(?:Max\.?\s*Marks?)\s*[:\=\-]?\s*(\d+)",
]
OR_LINE = r"^\s*(?:OR|or|Or)\s*$"
CHALLENGE = r"(?i)(?:challeng|bonus|extra\s+credit)"


def paper_lines(papers: DataFrame) -> DataFrame:
    """exam_id, line_no (from 0), line of ``papers(exam_id, text)``."""
    return papers.select("exam_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


#: Characters that stand between the groups of a match; none of them is text.
_START, _GROUP, _END = "\u0001", "\u0002", "\u0003"


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "\n", ""))


def _table_lines(body: Column) -> Column:
    """array<struct<at, f>> of the marks rows among a paper's lines: number, part, text and marks of each, matched once."""
    groups = _START + _GROUP.join(f"${i}" for i in (1, 2, 3, 4))
    cut = lambda line: F.split(F.regexp_replace(strip(line), ROW, groups), _GROUP)
    found = F.transform(F.split(body, "\n", -1), lambda line, i: F.struct(i.alias("at"), cut(line).alias("f")))
    number = lambda x: F.substring(x["f"][0], 2, 2).try_cast("int")
    marks = lambda x: F.regexp_extract(F.get(x["f"], F.lit(3)), r"^\d+", 0).try_cast("int")
    return F.filter(found, lambda x: F.startswith(x["f"][0], F.lit(_START)) & number(x).between(1, 15) & marks(x).between(1, 20))


def _running_text(body: Column) -> Column:
    """The same struct for each mark in running text: key, four kinds of marks, the match and what stands after it; the first has only that."""
    groups = _START + _GROUP.join(f"${i}" for i in (1, 3, 4, 5, 6, 0)) + _END
    parts = F.split(F.regexp_replace(body, CLASSIC, groups), _START, -1)
    return F.transform(parts, lambda p: F.struct(F.lit(None).cast("int").alias("at"), F.split(F.replace(p, F.lit(_END), F.lit(_GROUP)), _GROUP, -1).alias("f")))


def _numbered(x: DataFrame) -> DataFrame:
    """The line of each mark in running text: the newlines before it, and those it begins with."""
    match, gap = F.get("f", F.lit(5)), F.element_at("f", -1)
    lead = F.regexp_extract(match, r"^(\n\s*)", 1)
    passed = F.coalesce(_newlines(match), F.lit(0)) + _newlines(gap)
    before = F.sum(F.when(F.col("at").isNull(), passed)).over(Window.partitionBy("exam_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    line = F.coalesce("at", (F.coalesce(before, F.lit(0)) + _newlines(lead)).cast("int"))
    return x.withColumn("line_no", line).where(F.col("at").isNotNull() | (F.size("f") > 1))


def _rows_of(x: DataFrame, bare_parts: bool) -> DataFrame:
    """q_key, marks and q_text of the rows that count, the first of each key."""
    f = lambda i: F.get("f", F.lit(i))
    table = F.col("at").isNotNull()
    letter = F.regexp_replace(F.lower(f(1)), "[^a-z]", "")
    part = letter if bare_parts else F.when(F.rlike(f(1), F.lit(r"[\)\}\]]")), letter).otherwise("")
    text = f(2) if bare_parts else F.when((part == "") & (letter != ""), F.concat(strip(f(1)), f(2))).otherwise(f(2))
    number = F.substring(f(0), 2, 2).try_cast("int").cast("string")
    marks = F.coalesce(*[F.nullif(f(i), F.lit("")).try_cast("int") for i in (1, 2, 3, 4)])
    x = x.withColumn("q_key", F.when(table, F.concat(number, part)).otherwise(F.lower(f(0))))
    x = x.withColumn("marks", F.when(table, F.regexp_extract(f(3), r"^\d+", 0).try_cast("int")).otherwise(marks)).withColumn("q_text", F.when(table, strip(text)).otherwise(""))
    x = x.where(table | (F.col("marks").between(1, 20) & base_number(F.col("q_key")).try_cast("int").between(1, 20)))
    first = F.row_number().over(Window.partitionBy("exam_id", "q_key").orderBy("line_no", "no"))
    return x.withColumn("first", first).where("first = 1").select("exam_id", "q_key", "line_no", "marks", "q_text")


def _spread(papers: DataFrame, pick: Column) -> DataFrame:
    body = F.translate(F.coalesce("text", F.lit("")), _START + _GROUP + _END, "")
    x = papers.select("exam_id", body.alias("body")).withColumn("table", _table_lines(F.col("body")))
    return x.select("exam_id", F.posexplode(pick).alias("no", "x")).select("exam_id", "no", "x.at", "x.f")


def marks_rows(papers: DataFrame, bare_parts: bool = False) -> DataFrame:
    """exam_id, q_key, line_no, marks, q_text: rows of a number, text and marks; numbers 1..15, marks 1..20, first of each key.

    A part letter needs a closing bracket, so that a text in lower case is not taken for one; ``bare_parts`` takes any letter.
    ``papers`` has a row for each exam.
    """
    return _rows_of(_spread(papers, F.col("table")).withColumn("line_no", F.col("at")), bare_parts)


def classic_rows(papers: DataFrame) -> DataFrame:
    """As marks_rows, from marks in running text (``[5 marks]``, ``(5 marks)``, ``marks: 5``, ``5 marks``), with the real line."""
    return _rows_of(_numbered(_spread(papers, _running_text(F.col("body")))), False)


def question_rows(papers: DataFrame, bare_parts: bool = False) -> DataFrame:
    """Marks rows, and for papers without any the rows of running text: one pass over the papers."""
    pick = F.when(F.size("table") > 0, F.col("table")).otherwise(_running_text(F.col("body")))
    return _rows_of(_numbered(_spread(papers, pick)), bare_parts)


def total_marks(papers: DataFrame) -> DataFrame:
    """exam_id, total_marks: the first number from 20 to 100 of the first pattern that has one, else null."""
    def first(p: str) -> Column:
        found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), 1), lambda v: v.try_cast("int"))
        return F.get(F.filter(found, lambda v: v.between(20, 100)), F.lit(0))

    return papers.select("exam_id", F.coalesce(*[first(p) for p in TOTALS]).alias("total_marks"))


def markers(papers: DataFrame, line_before: bool = False) -> DataFrame:
    """exam_id, kind (or, head), line_no, at: OR lines and challenge headings. ``at`` is where an OR is measured from: its own
    line, or with ``line_before`` the last line with text above it (an OR without one is left out)."""
    lines = papers.select("exam_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    lines = lines.select("exam_id", "lines", F.posexplode("lines").alias("line_no", "line"))
    kind = F.when(F.rlike("line", F.lit(OR_LINE)), "or").when(F.rlike("line", F.lit(CHALLENGE)), "head")
    found = lines.withColumn("kind", kind).where("kind is not null")
    above = F.array_max(F.filter(F.sequence(F.lit(0), F.col("line_no")), lambda i: (i < F.col("line_no")) & (strip(F.get("lines", i)) != "")))
    at = F.when(F.col("kind") == "or", above).otherwise(F.col("line_no")) if line_before else F.col("line_no")
    return found.select("exam_id", "kind", "line_no", at.alias("at")).where("at is not null")


def placed(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows(exam_id, q_key, line_no, marks)`` with group_id and hard (the number of the exam's challenge question, or null).

    The nearest question on either side of an OR is an as-of step: rows and markers of an exam in order of their lines, and
    the last number seen from above and from below. Questions on both sides share the smaller number; a later OR overrides.
    Every window is one of the exam, so rows and markers are dealt out once.
    """
    base = base_number(F.col("q_key")).try_cast("int")
    q = rows.select("exam_id", F.lit("q").alias("kind"), "line_no", F.col("line_no").alias("at"), "q_key", "marks", base.alias("base"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("q_key", "string"), ("marks", "int"), ("base", "int"))]
    x = q.unionByName(marks.select("exam_id", "kind", "line_no", "at", *none))
    exam, is_q = Window.partitionBy("exam_id"), F.col("kind") == "q"
    # at one line the marker comes first from both sides, so a question there is on neither
    place, seen = F.when(is_q, 1).otherwise(0), F.last("base", ignorenulls=True)
    x = x.withColumn("above", seen.over(exam.orderBy("at", place, "base").rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("below", seen.over(exam.orderBy(F.desc("at"), place, F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)))
    pair = F.struct("line_no", F.least("above", "below").alias("g"), F.col("above").alias("a"), F.col("below").alias("b"))
    x = x.withColumn("pairs", F.collect_list(F.when((F.col("kind") == "or") & (F.col("above") != F.col("below")), pair)).over(exam))
    x = x.withColumn("head", F.min(F.when(F.col("kind") == "head", F.col("line_no"))).over(exam))
    x = x.withColumn("later", F.max(F.when(is_q & (F.col("line_no") > F.col("head")), F.col("base"))).over(exam)).withColumn("highest", F.max("base").over(exam))
    last = F.array_max(F.filter("pairs", lambda p: (p["a"] == F.col("base")) | (p["b"] == F.col("base"))))
    hard = F.when(F.col("head").isNotNull(), F.coalesce("later", "highest"))
    return x.where(is_q).select("exam_id", "q_key", "marks", "base", F.coalesce(last["g"].cast("string"), F.col("q_key")).alias("group_id"), hard.alias("hard"))


def or_groups(rows: DataFrame, papers: DataFrame, line_before: bool = False) -> DataFrame:
    """exam_id, q_key, group_id: questions on both sides of an OR line share the smaller number; a later OR overrides.

    The sides are the nearest rows before and after. ``line_before`` measures from the last line with text before the OR
    instead, and then a row on that very line is on neither side.
    """
    return placed(rows, markers(papers, line_before)).select("exam_id", "q_key", "group_id")


def challenge_numbers(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """exam_id, base: of the papers with a challenge heading, the highest number on a later line, else the highest of all."""
    return placed(rows, markers(papers)).where("hard is not null").groupBy("exam_id").agg(F.max("hard").cast("string").alias("base"))


def rubric(papers: DataFrame, bare_parts: bool = False, line_before: bool = False) -> DataFrame:
    """exam_id, q_key, max_marks, q_type (mandatory, optional, challenge), group_id for ``papers(exam_id, text)``."""
    g = placed(question_rows(papers, bare_parts), markers(papers, line_before))
    alone = F.count("*").over(Window.partitionBy("exam_id", "group_id")) == 1
    kind = F.when(F.col("base") == F.col("hard"), "challenge").when(alone, "mandatory").otherwise("optional")
    return g.select("exam_id", "q_key", F.col("marks").alias("max_marks"), kind.alias("q_type"), "group_id")


def usable_rows(rows: DataFrame, most: int = 20) -> DataFrame:
    """The rows of papers whose numbers are all up to ``most``; a paper with a higher one is garbage as a whole."""
    bad = rows.where(base_number(F.col("q_key")).try_cast("int") > most).select("exam_id").distinct()
    return rows.join(bad, "exam_id", "left_anti")


#: Keys whose presence shows that a paper has questions in two parts.
PART_KEYS = ["7a", "7b", "8a", "8b", "9a", "9b"]


def schema_state(papers: DataFrame) -> DataFrame:
    """exam_id, n_keys, total_marks, kind (rubric, total, none), has_parts: what a paper says about its marks."""
    # as usable_rows, but the rows are found once
    top = F.coalesce(F.max(base_number(F.col("q_key")).try_cast("int")), F.lit(0))
    per = question_rows(papers).groupBy("exam_id").agg(F.count("*").alias("n_keys"), F.bool_or(F.col("q_key").isin(PART_KEYS)).alias("has_parts"), top.alias("top")).where("top <= 20").drop("top")
    out = total_marks(papers).join(per, "exam_id", "left")
    kind = F.when(F.col("n_keys") > 0, "rubric").when(F.col("total_marks").isNotNull(), "total").otherwise("none")
    return out.select("exam_id", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), "total_marks", kind.alias("kind"), F.coalesce("has_parts", F.lit(False)).alias("has_parts"))
