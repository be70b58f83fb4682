"""Progress of streaming runs as rows (STM-2): a listener stores what happens, and whoever comes later has it replayed.

Rows: run (id of the query's run), at (number of the event within it), phase (started, batch, failed, finished), batch,
rows, millis, error. The listener appends a small file an event under ``path``, in the store that Spark writes to, so that
another driver can follow; it keeps nothing but the number of the last event of each run that is going on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQueryListener

ROW = "run string, at long, phase string, batch long, rows long, millis long, error string"


class ProgressLog(StreamingQueryListener):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.last = spark, path, {}

    def _add(self, run, phase: str, batch=None, rows=None, millis=None, error=None) -> None:
        at = self.last[str(run)] = self.last.get(str(run), -1) + 1
        row = self.spark.createDataFrame([(str(run), at, phase, batch, rows, millis, error)], ROW)
        row.coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event) -> None:
        self._add(event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(p.runId, "batch", p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(event.runId, "failed" if event.exception else "finished", error=event.exception)
        self.last.pop(str(event.runId), None)


def events(spark: SparkSession, path: str, run: str | None = None, behind: int = -1) -> DataFrame:
    """The events of a run, or of all, behind a number: what a follower asks for again and again. One that was told twice
    counts once."""
    e = spark.read.schema(ROW).json(path).where(F.col("at") > behind)
    return (e if run is None else e.where(F.col("run") == run)).dropDuplicates(["run", "at"])


def state(spark: SparkSession, path: str) -> DataFrame:
    """Where each run stands for one who joins now: run, phase (the last one), batches, rows, millis, error, at."""
    e = events(spark, path)
    last = W.partitionBy("run").orderBy(F.desc("at"))
    now = e.withColumn("n", F.row_number().over(last)).where("n = 1").select("run", "at", "phase", "error")
    done = e.where("phase = 'batch'").groupBy("run").agg(F.count_distinct("batch").alias("batches"), F.sum("rows").alias("rows"), F.sum("millis").alias("millis"))
    zero = F.lit(0).cast("long")
    return now.join(done, "run", "left").select("run", "phase", *(F.coalesce(c, zero).alias(c) for c in ("batches", "rows", "millis")), "error", "at")
