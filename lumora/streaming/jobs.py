"""The state of each grading job, kept up to date from a stream of changes, and the latest result of each exam.

A job is idle, processing, then done or error; nothing leads on from an end. A stateful operator holds one small state a job:
changes that would go back in time, or that the state does not allow, are counted and ignored; a job that says nothing for
``timeout`` (in the time of the changes, by watermark) ends in an error. Only changed jobs are written, to slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumora.sources import slots
from lumora.sources.files import NEXT, percent

CHANGES = "job_id string, at timestamp, step int, total int, status string, message string"
STATES = CHANGES + ", changes long, ignored long"
_STATE = "at timestamp, step int, total int, status string, message string, changes long, ignored long"


def changes(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """The stream of changes of a folder; each file is read once."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_at_once).json(folder)


def _missing(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v)) else v


def _follow(timeout_ms: int, zone: str):
    def follow(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, step, total, status, message, taken, ignored = state.get if state.exists else (None, None, None, "idle", None, 0, 0)
        if state.hasTimedOut:
            status, message, taken = "error", "timed out", taken + 1
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["at", "step", "total", "status", "message"])])
        # a missing time or step comes first, as it does where a table of changes is sorted
        for r in rows.sort_values(["at", "step"], na_position="first", kind="stable").itertuples(index=False):
            when = _missing(r.at)
            late = at is not None and (when is None or when < at)
            if late or r.status not in NEXT.get(status, ()):
                ignored += 1
                continue
            at, step, total, status, message, taken = when or at, _missing(r.step), _missing(r.total), r.status, _missing(r.message), taken + 1
        whole = lambda v: None if v is None else int(v)
        now = (at, whole(step), whole(total), status, message, taken, ignored)
        state.update(now)
        if timeout_ms and status == "processing" and at is not None:
            due = int(pd.Timestamp(at).tz_localize(zone).timestamp() * 1000) + timeout_ms
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *now)], columns=[c.split()[0] for c in STATES.split(", ")]).astype({"step": "Int32", "total": "Int32"})

    return follow


def states(stream: DataFrame, timeout_ms: int = 0, late_ms: int = 600_000) -> DataFrame:
    """STATES of the jobs that a batch of ``stream`` (CHANGES) touches, or that time out; 0: none does."""
    if timeout_ms:
        stream = stream.withWatermark("at", f"{late_ms} milliseconds")
    kind = GroupStateTimeout.EventTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.where("job_id is not null").groupBy("job_id").applyInPandasWithState(_follow(timeout_ms, stream.sparkSession.conf.get("spark.sql.session.timeZone")), STATES, _STATE, "update", kind)


def keep_states(stream: DataFrame, store: str, checkpoint: str, once: bool = False, timeout_ms: int = 0, late_ms: int = 600_000, every: int = 50) -> StreamingQuery:
    """Follows the stream and puts each batch's changed jobs into the slots of ``store``; with ``once`` it ends when all files are
    read. What a lost executor held comes back from the checkpoint, and a batch that is repeated replaces itself."""

    def write(changed: DataFrame, no: int) -> None:
        slots.put(changed, store, "job_id", no, every)

    sink = states(stream, timeout_ms, late_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (sink.trigger(availableNow=True) if once else sink).start()


def progress(spark: SparkSession, store: str, job_id: str | None = None) -> DataFrame:
    """STATES and percent of all jobs, or of one; a job that no change was seen of is idle."""
    found = slots.current(spark, store, "job_id")
    if found is None:
        found = spark.createDataFrame([], STATES)
    if job_id is not None:
        asked = spark.createDataFrame([(job_id,)], "job_id string")
        found = asked.join(found.where(F.col("job_id") == job_id), "job_id", "left").withColumn("status", F.coalesce("status", F.lit("idle")))
        found = found.fillna(0, ["changes", "ignored"])
    return found.withColumn("percent", percent(F.col("status"), F.col("step"), F.col("total")))


def keep_results(results: DataFrame, store: str, no: int, at=None) -> None:
    """Puts ``results(exam_id, student_id, ...)`` of a run into one slot an exam: a later run's rows take the place of an exam's rows."""
    rest = [c for c in results.columns if c != "exam_id"]
    when = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
    slots.put(results.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows")).withColumn("at", when), store, "exam_id", no)


def results(spark: SparkSession, store: str, exam_id=None) -> DataFrame | None:
    """exam_id, at and the rows of the latest run of each exam, or of one; None before the first run."""
    found = slots.current(spark, store, "exam_id")
    if found is None:
        return None
    if exam_id is not None:
        found = found.where(F.col("exam_id") == exam_id)
    return found.select("exam_id", "at", F.inline("rows"))
