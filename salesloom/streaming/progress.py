"""What streams report of themselves, as rows of a metrics table: input, late rows dropped, rows held in state."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch_id long, ts string, input_rows long, dropped_rows long, state_rows long"


class ProgressLog(StreamingQueryListener):
    """A row for each batch of the session's queries that carry one of ``names`` (all without), written as Parquet.

    Rows are gathered where Spark calls back and written when a query ends or ``flush`` is called, each time into a
    file set of its own. A batch's late rows are those that any of its stateful operators dropped by the watermark.
    """

    def __init__(self, spark: SparkSession, path: str, names: frozenset[str] = frozenset()):
        self.spark, self.path, self.names = spark, path, names
        self.rows: list[tuple] = []
        self.lock, self.ended = threading.Lock(), threading.Event()
        self.watched: dict[str, str] = {}

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    def onQueryStarted(self, event) -> None:
        if not self.names or event.name in self.names:
            self.watched[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = self.watched.get(str(p.id))
        if name is None:
            return
        operators = p.stateOperators
        row = (
            name, p.batchId, p.timestamp, p.numInputRows,
            sum(o.numRowsDroppedByWatermark for o in operators), sum(o.numRowsTotal for o in operators),
        )
        with self.lock:
            self.rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.watched:
            self.ended.set()

    def wait(self, seconds: float = 60) -> None:
        """Until the end of a query has been told: its last batches are told before that."""
        if not self.ended.wait(seconds):
            raise TimeoutError("no query ended")

    def flush(self) -> None:
        """Appends the rows gathered so far; a row per batch, never more."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        rows = self.spark.read.schema(PROGRESS).parquet(self.path)
        return rows.withColumn("ts", F.to_timestamp("ts"))


def totals(progress: DataFrame) -> DataFrame:
    """Input and dropped rows per query, and the most rows its state held."""
    return progress.groupBy("query").agg(
        F.sum("input_rows").alias("input_rows"),
        F.sum("dropped_rows").alias("dropped_rows"),
        F.max("state_rows").alias("most_state_rows"),
    )
