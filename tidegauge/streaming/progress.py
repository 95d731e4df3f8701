"""Progress of streaming queries as rows.

Rows are counted at three stages: as they come from the source and, where the query
itself has windows, out of them (``DataFrame.observe`` in the jobs), and as the sink
writes them (counted there, since a batch's own aggregation runs in the sink).
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import StreamingQueryProgress

from tidegauge.streaming import sinks

PROGRESS = (
    T.StructType()
    .add("query", "string").add("run_id", "string").add("batch_id", "long").add("started", "string")
    .add("rows_in", "long").add("rows_in_per_second", "double").add("rows_processed_per_second", "double")
    .add("batch_millis", "long").add("state_rows", "long").add("rows_emitted", "long")
    .add("rows_dropped_late", "long")
    .add("rows_from_source", "long").add("rows_from_windows", "long").add("rows_written", "long")
)


def progress_row(progress: StreamingQueryProgress) -> tuple:
    operators = progress.stateOperators
    observed = {name: row["rows"] for name, row in progress.observedMetrics.items() if name in ("source", "window")}
    return (
        progress.name or str(progress.id), str(progress.runId), progress.batchId, progress.timestamp,
        progress.numInputRows, progress.inputRowsPerSecond, progress.processedRowsPerSecond,
        progress.durationMs.get("triggerExecution", 0),
        sum(o.numRowsTotal for o in operators),
        sum(o.numRowsUpdated for o in operators),
        sum(o.numRowsDroppedByWatermark for o in operators),
        observed.get("source"), observed.get("window"), sinks.written.get((str(progress.id), progress.batchId)),
    )


def progress_frame(spark: SparkSession, progress: Iterable[StreamingQueryProgress]) -> DataFrame:
    """One row per batch; the list is one of Spark's bounded progress buffers."""
    rows = spark.createDataFrame([progress_row(p) for p in progress], PROGRESS)
    return rows.withColumn("started", F.to_timestamp("started"))


class ProgressTable(StreamingQueryListener):
    """Appends the progress of every query of a session to a table.

    Rows are held back until ``every`` of them make a file worth writing, or a
    query ends.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 60):
        self.spark, self.path, self.every, self.held = spark, path, every, []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.held.append(event.progress)
        if len(self.held) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all progress of an ended query is in the table."""
        with self._change:
            if not self._change.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the query's end was not reported")

    def flush(self) -> None:
        held, self.held = self.held, []
        if held:
            progress_frame(self.spark, held).coalesce(1).write.mode("append").parquet(self.path)


def throughput(progress: DataFrame) -> DataFrame:
    """Totals and rates per query.

    Emitted are the rows that the sink wrote; of a sink that does not count, the rows of
    state that changed.
    """
    return progress.groupBy("query").agg(
        F.sum(F.coalesce("rows_from_source", "rows_in")).alias("total_in"),
        F.sum("rows_from_windows").alias("total_from_windows"),
        F.sum(F.coalesce("rows_written", "rows_emitted")).alias("total_emitted"),
        F.sum("rows_dropped_late").alias("total_dropped_late"),
        F.try_divide(F.sum("rows_in") * 1000.0, F.sum("batch_millis")).alias("rows_per_second"),
        F.max("state_rows").alias("peak_state_rows"),
        F.count("*").alias("batches"),
    )
