"""Stages of a job: the rows and errors of each written step, observed as it is written, and the seconds it took."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumora.sources import stored

STAGES = "no int, stage string, rows long, errors long, seconds double, status string, message string"


class Stages:
    """Cuts a plan at named steps. As a context it adds the whole job as a last row, and the error that ended it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.done, self.began, self.open = spark, [], time.time(), "total"

    def cut(self, df: DataFrame, stage: str, wrong: Column | None = None) -> DataFrame:
        """``df`` as a checkpoint; its rows, and those for which ``wrong`` holds, are counted on the way, without a pass of their own."""
        self.open, began, seen = stage, time.time(), Observation(f"{stage}-{len(self.done)}")
        errors = F.count_if(wrong) if wrong is not None else F.count_if(F.lit(False))
        out = stored.cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), errors.alias("errors")))
        self.done.append((stage, int(seen.get["rows"]), int(seen.get["errors"]), time.time() - began, "done", None))
        self.open = "total"
        return out

    def __enter__(self) -> Stages:
        self.began = time.time()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        status, message = ("done", None) if error is None else ("error", f"{self.open}: {error}"[:1000])
        self.done.append(("total", sum(d[1] for d in self.done), sum(d[2] for d in self.done), time.time() - self.began, status, message))
        return False

    def table(self) -> DataFrame:
        """STAGES: one row for each step so far."""
        return self.spark.createDataFrame([(i + 1, s, r, e, round(t, 3), status, m) for i, (s, r, e, t, status, m) in enumerate(self.done)], STAGES)
