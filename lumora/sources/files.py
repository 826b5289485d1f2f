"""File sources and sinks: uploads, scans, whole texts, the latest upload, reports and job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED, OPTIONAL = ("student_file", "model_file"), ("question_file",)
SCANS = "*.{png,jpg,jpeg,tif,tiff,bmp}"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """exam, role, path, length, modified, content: files ``folder/<exam>/<role>.<any>``; only known roles count.

    Names come from the listing, so nothing a sender writes becomes part of a path. Spark lists no empty files; they are missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)/([^/]+?)(?:\.[^./]*)?$", 2)
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("exam"), name.alias("role"), "path", "length", F.col("modificationTime").alias("modified"), "content")
    return rows.where(F.col("role").isin(*REQUIRED, *OPTIONAL))


def upload_states(files: DataFrame) -> DataFrame:
    """exam, status (202 accepted, 400 rejected), missing: the required roles that are absent or empty."""
    have = files.groupBy("exam").agg(F.collect_set(F.when(F.col("length") > 0, F.col("role"))).alias("roles"))
    missing = F.array_except(F.lit(list(REQUIRED)), "roles")
    return have.select("exam", F.when(F.size(missing) == 0, 202).otherwise(400).alias("status"), missing.alias("missing"))


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of single images; they are one page and get no page mark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SCANS).load(folder)
    return files.select("path", "length", "content")


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text: each file as one row."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def latest(files: DataFrame, *by: str) -> DataFrame:
    """Of ``files(path, modified, ...)`` the newest row, or the newest of each group; of equal times the larger path."""
    rest = [c for c in files.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct("modified", "path")).alias("x")
    return files.groupBy(*by).agg(newest).where("x is not null").select(*by, "x.*")


def write_texts(rows: DataFrame, path: str) -> None:
    """One column of text, a file for each partition."""
    rows.write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report's rows as JSON lines, by exam."""
    rows.write.mode("overwrite").partitionBy("exam_id").json(path)


# The states of a job, and which state may follow which.
NEXT = {"idle": ("idle", "processing", "error"), "processing": ("processing", "done", "error")}
ENDS = ("done", "error")


def percent(status: Column, step: Column, total: Column) -> Column:
    """How far a job is: 100 once done, else the share of its steps."""
    return F.when(status == "done", 100.0).when(total > 0, F.round(100.0 * F.coalesce(step, F.lit(0)) / total, 1)).otherwise(0.0)


def job_states(changes: DataFrame) -> DataFrame:
    """job_id, at, step, total, status, message, changes, ignored, percent: where ``changes(job_id, at, step, total, status, message)`` lead.

    The same rules as those of the stream, for a whole table: from idle to processing, then to done or error; an error may
    come at once; nothing follows an end. In the order of at, step (nulls first) and the rest, what the state does not
    allow is ignored. The first start and the first end that counts decide, so a job's rows need no fold, only windows.
    """
    job = Window.partitionBy("job_id")
    order = job.orderBy(F.col("at").asc_nulls_first(), F.col("step").asc_nulls_first(), "status", F.col("total").asc_nulls_first(), F.col("message").asc_nulls_first())
    c = changes.where("job_id is not null").withColumn("no", F.row_number().over(order))
    c = c.withColumn("start", F.min(F.when(F.col("status") == "processing", F.col("no"))).over(job))
    ends = (F.col("status") == "error") | ((F.col("status") == "done") & (F.col("no") > F.col("start")))
    c = c.withColumn("end", F.min(F.when(ends, F.col("no"))).over(job))
    before_end = F.col("end").isNull() | (F.col("no") <= F.col("end"))
    started = F.col("start").isNotNull() & (F.col("no") >= F.col("start"))
    known = (F.col("status").isin("processing", *ENDS) & started) | (F.col("status").isin("idle", "error") & ~started)
    c = c.withColumn("counts", F.coalesce(before_end & known, F.lit(False)))
    last = F.max(F.when(F.col("counts"), F.struct("no", "at", "step", "total", "status", "message"))).alias("x")
    g = c.groupBy("job_id").agg(last, F.count_if("counts").alias("changes"), F.count_if(~F.col("counts")).alias("ignored"))
    status = F.coalesce("x.status", F.lit("idle"))
    return g.select("job_id", "x.at", "x.step", "x.total", status.alias("status"), "x.message", "changes", "ignored", percent(status, F.col("x.step"), F.col("x.total")).alias("percent"))
