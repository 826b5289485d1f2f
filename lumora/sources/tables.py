"""Deterministic views of the driver's tables as grading inputs, so that every operator runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a task, so that a task's memory does not grow with the tables.
ROWS_A_TASK = 250_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Into how many partitions exams are dealt: by the number of line items, which Parquet knows."""
    return max(spark.sparkContext.defaultParallelism, -(-read(spark, sf_dir, "lineitem").count() // ROWS_A_TASK))


def dealt(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str = "exam_id") -> DataFrame:
    """The rows of an exam in one partition; groups, windows and joins by exam go on from there without another exchange."""
    return rows.repartition(parts(spark, sf_dir), key)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam_id"), F.concat(F.col("l_linenumber").cast("string"), _part()).alias("q_key"))


def exam_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, q_key: one model key for each line item, with a part letter from its return flag."""
    return dealt(model_rows(spark, sf_dir), spark, sf_dir).distinct()


def _part():
    return F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "b").otherwise("")


def student_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, num = F.col("l_quantity"), F.col("l_linenumber").cast("string")
    key = F.when(q > 40, num).when(q > 30, F.concat(num, F.lit("a"))).when(q < 5, None).otherwise(F.concat(num, _part()))
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam_id"), F.lit(1).alias("student_id"), key.alias("q_key"), F.col("l_partkey").cast("string").alias("text"))
    return s.where("q_key is not null")


def exam_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, student_id, q_key, text: answers under other keys than the model's, by quantity; some are missing."""
    return dealt(student_rows(spark, sf_dir), spark, sf_dir).groupBy("exam_id", "student_id", "q_key").agg(F.min("text").alias("text"))


def rubric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.col("l_linenumber").cast("string")
    key = F.when(F.col("l_discount") < 0.05, num).otherwise(F.concat(num, _part()))
    kind = F.when(F.col("l_linenumber") == 7, "challenge").when(F.col("l_linenumber") > 2, "optional").otherwise("mandatory")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam_id"), key.alias("q_key"), (1 + F.round(F.col("l_tax") * 100)).cast("int").alias("m"), kind.alias("t"), F.floor((F.col("l_linenumber") + 1) / 2).cast("int").cast("string").alias("g"))


def exam_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(rubric_rows(spark, sf_dir), spark, sf_dir).groupBy("exam_id", "q_key").agg(F.max("m").alias("max_marks"), F.max("t").alias("q_type"), F.max("g").alias("group_id"))


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.when(F.col("o_orderpriority") < "3", (20 + F.floor("o_totalprice") % 60).cast("int"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exam_id"), total.alias("total"))
    return dealt(orders, spark, sf_dir).groupBy("exam_id").agg(F.max("total").alias("total_marks"))


def exam_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of an exam: 1 and 2 are mandatory, of the others two numbers share a group; the score is a fifth of the quantity."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    kind = F.when(n == 7, "challenge").when(n < 3, "mandatory").otherwise("optional")
    group = F.when(n < 3, n).otherwise(F.floor((n + 1) / 2) + 1).cast("int").cast("string")
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam_id"), F.lit(1).alias("student_id"), F.concat(n.cast("string"), _part()).alias("q_key"), n.cast("string").alias("base_key"), group.alias("group_id"), kind.alias("q_type"), F.bround(q / 5, 1).alias("score"))
    return dealt(s, spark, sf_dir).groupBy("exam_id", "student_id", "q_key", "base_key", "group_id", "q_type").agg(F.max("score").alias("score")).withColumn("max_marks", F.lit(10))


def dialogue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, student, model: a user's turn against the assistant's next one."""
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("student"))
    m = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("model"))
    return u.join(m, ["conv_id", "turn"]).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"), "student", "model")


def numbered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a conversation as an answer sheet; user turns open questions (numbers go up and down), others are parts."""
    n = ((F.col("turn") * 5) % 9 + 1).cast("string")
    line = F.when(F.col("role") == "user", F.concat(F.lit("\n"), n, F.lit(". "), "text")).otherwise(F.concat(F.lit("\na) "), "text", F.lit("\nb) "), "role", F.lit(" part")))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(line, F.lit("")).alias("line"))
    g = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "line"))).alias("x"))
    return g.select("doc_id", F.concat(F.lit("Sheet of answers"), F.array_join(F.col("x.line"), "")).alias("text"))


def headed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a conversation as scanned sheets; a new sheet with a header every third turn, lines of marks after odd ones."""
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Additional Sheet of roll "), F.col("conv_id").cast("string"), F.lit("\nname\ndate\n"))).otherwise("")
    foot = F.when(F.col("turn") % 2 == 1, "\nSub Total\nCO 3").otherwise("")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(head, F.coalesce("text", F.lit("")), foot).alias("sheet"))
    g = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "sheet"))).alias("x"))
    return g.select("doc_id", F.array_join(F.col("x.sheet"), "\n").alias("text"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, similarity: the vector of an even id against that of the next odd one."""
    from lumora.operators.similarity import cosine

    e = read(spark, sf_dir, "embeddings").withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    s = e.where("vec_id % 2 = 0").select("pair_id", F.col("embedding").alias("a"))
    m = e.where("vec_id % 2 = 1").select("pair_id", F.col("embedding").alias("b"))
    return s.join(m, "pair_id").select("pair_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, text: the line items of an order as a question paper, a line each, with OR lines and bonus headings between.

    Three of four papers have marks at the ends of rows; the fourth has them in running text. Two of three name a total.
    """
    num, marks = F.col("l_linenumber") * 2 + F.col("l_partkey") % 2, (1 + F.col("l_suppkey") % 22).cast("string")
    num, topic = num.cast("string"), F.col("l_partkey").cast("string")
    opening = F.when(F.col("l_returnflag") == "A", ".a) |").when(F.col("l_returnflag") == "R", ") b) ").otherwise(". |")
    row = F.concat(num, opening, F.lit("Explain topic "), topic, F.lit(" of the unit  "), marks, F.lit(" |CO"), (F.col("l_suppkey") % 5 + 1).cast("string"))
    form = F.col("l_partkey") % 4
    said = (F.when(form == 0, F.concat(F.lit(" in short ["), marks, F.lit(" marks]"))).when(form == 1, F.concat(F.lit(" in short ("), marks, F.lit(" Marks)")))
            .when(form == 2, F.concat(F.lit(" in short, Marks: "), marks)).otherwise(F.concat(F.lit(" in short "), marks, F.lit(" marks"))))
    running = F.concat(F.lit("Q"), num, F.lit(". Describe topic "), topic, said)
    line = F.concat(F.when(F.col("l_orderkey") % 4 == 0, running).otherwise(row), F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), "\nOR").otherwise(""), F.when(F.col("l_quantity") > 48, "\nBonus questions").otherwise(""))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", *order, "l_returnflag", "l_linestatus")
    g = dealt(items, spark, sf_dir, "l_orderkey").withColumn("line", line).groupBy(F.col("l_orderkey").alias("exam_id")).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("x"))
    total = (15 + F.col("exam_id") % 100).cast("string")
    head = F.when(F.col("exam_id") % 3 == 0, F.concat(F.lit("Max. Marks: "), total, F.lit("\n"))).when(F.col("exam_id") % 3 == 1, F.concat(F.lit("Total marks = "), total, F.lit("\n"))).otherwise("")
    return g.select("exam_id", F.concat(head, F.array_join(F.col("x.line"), "\n")).alias("text"))


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, text, error: a conversation as a scanned file, a turn as a page. Turns without a text are errors."""
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), no.alias("page_no"), "text", F.when(F.col("text").isNull(), "no text").alias("error"))


def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, at, step, total, status, message: the events of a user and a day as the changes of a job."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "idle").when(kind.isin("click", "signup"), "processing").when(kind == "purchase", "done").otherwise("error")
    e = read(spark, sf_dir, "events")
    job = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return e.select(job.alias("job_id"), F.col("ts").alias("at"), (F.col("event_id") % 7).cast("int").alias("step"), F.lit(6).alias("total"), status.alias("status"), kind.alias("message"))
