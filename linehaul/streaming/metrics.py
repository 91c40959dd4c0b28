"""Counts of micro-batches as Spark itself reports them, without a job or a Python call a batch."""

from __future__ import annotations

import threading
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from linehaul.session import log
from linehaul.sinks.tables import keep_batch
from linehaul.streaming.counting import COUNTS_SCHEMA


class BatchMetrics(StreamingQueryListener):
    """Stores ``(ts, count)`` of every micro-batch of one query; read them with ``stored_report``.

    ``observe`` adds the count to the query's plan, where it runs along with the write, whatever
    the sink. Spark sends the figures when a batch has ended, and each becomes a small
    file. A driver that stops right between a batch's commit and that message leaves the batch
    unnoted; where every batch must be noted, use ``rows_log`` of ``run_stream``.
    """

    def __init__(self, spark: SparkSession, counts_path: str):
        self.spark, self.counts_path = spark, counts_path
        self.name = f"rows_{uuid.uuid4().hex}"
        self._ended: set[str] = set()
        self._changed = threading.Condition()
        spark.streams.addListener(self)

    def observe(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.name, F.count(F.lit(1)).alias("rows"))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until all figures of a query that has ended are stored."""
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                log.warning("figures of query %s may be missing", query.id)

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is None:
            return
        ts = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
        note = (round(ts.timestamp() * 1000), row["rows"])
        keep_batch(self.spark, self.counts_path, progress.batchId, COUNTS_SCHEMA, [note])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()
