"""How far a stream is, told while it runs: a listener writes a row after each batch."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: What a row of progress has.
PROGRESS = "query string, batch long, at double, rows long, failed long, done long, total long, per_hour double, remaining_s double"


class ProgressTable(StreamingQueryListener):
    """Appends a row to a table of JSON for each batch of one query: what the batch had (as observed under a name, see sinks.observed), done since the start, the rate, and what time is left of total at that rate.

    The query is told by its name. Batches without an observation count their input rows. Nulls stand for what isn't known: a rate before anything is done, what is left without a total.
    """

    def __init__(self, spark: SparkSession, path: str, query: str, total: int | None = None, observation: str = "progress"):
        self.spark, self.path, self.query, self.total, self.observation = spark, path, query, total, observation
        self.began, self.done = time.time(), 0

    def row(self, batch: int, rows: int, failed: int | None, at: float) -> tuple:
        """The next row, after a batch of so many rows."""
        self.done += rows
        elapsed = at - self.began
        rate = self.done * 3600 / elapsed if self.done and elapsed > 0 else None
        left = None if self.total is None or rate is None else max(self.total - self.done, 0) * 3600 / rate
        return (self.query, batch, at, rows, failed, self.done, self.total, rate, left)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.query or not p.numInputRows:
            return
        seen = (p.observedMetrics or {}).get(self.observation)
        rows, failed = (seen["rows"], seen["failed"] if "failed" in seen else None) if seen is not None else (p.numInputRows, None)
        told = self.spark.createDataFrame([self.row(p.batchId, rows, failed, time.time())], PROGRESS)
        told.coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress_of(spark: SparkSession, path: str):
    """The rows of a ProgressTable, those of a query that still runs as well."""
    return spark.read.schema(PROGRESS).json(path)
