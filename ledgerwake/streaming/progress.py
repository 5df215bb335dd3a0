"""Progress of a streaming query as rows: what each micro-batch read and what came too late."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "batch_id long, n_read long, n_late long"


class BatchCounts(StreamingQueryListener):
    """Writes one row for each micro-batch that had data, of the queries with a given name.

    A late row is one that a stateful operator left out because the watermark had passed it;
    aggregations count what is left after combining within a task, `dropDuplicates` each row.
    A micro-batch that is repeated after a failure replaces its own row.
    """

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.runs: set[str] = set()
        self.idle = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self.idle.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.name and progress.numInputRows:
            late = sum(one.numRowsDroppedByWatermark for one in progress.stateOperators)
            row = self.spark.createDataFrame([(progress.batchId, progress.numInputRows, late)], COUNTS)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={progress.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.runs.discard(str(event.runId))
        if not self.runs:
            self.idle.set()

    def __enter__(self) -> BatchCounts:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        """Progress arrives after the batch, so the end of the query is waited for."""
        self.idle.wait(60)
        self.spark.streams.removeListener(self)

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(COUNTS).parquet(self.path)
        return rows.select("batch_id", "n_read", "n_late")
