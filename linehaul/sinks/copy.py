"""Copy text streamed into a relational server, one connection a write task.

A Spark data source whose tasks send their rows through ``COPY … FROM STDIN`` as they are computed, so nothing is
staged. Every task reports its rows and the time it took when it ends; Spark hands those reports to
the source's commit on the driver: the figures of a load cost no second read of its table.

``connect`` names a function as ``module:name`` that is called with ``dsn`` in each task and returns a
connection of the Python database interface whose cursors have ``copy`` (psycopg) or ``copy_expert``
(psycopg2). Such a driver is a package of the deployment and not installed here: the tests use a stand-in.
"""

from __future__ import annotations

import importlib
import io
import json
import os
import tempfile
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

REPORT = "task int, rows long, bytes long, started_ms long, ended_ms long"


@dataclass
class Copied(WriterCommitMessage):
    """What a write task did."""

    task: int
    rows: int
    bytes: int
    started_ms: int
    ended_ms: int


class _Text(io.RawIOBase):
    """Batches of lines as a file, for drivers that read one."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.rest = parts, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if not self.rest:
            self.rest = next(self.parts, b"")
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _lines(self, batches: Iterator[pa.RecordBatch], seen: list[int]) -> Iterator[bytes]:
        for batch in batches:
            if batch.num_rows:
                lines = pc.drop_null(batch.column(0))
                text = "".join(f"{line}\n" for line in lines.to_pylist()).encode()
                seen[0] += len(lines)
                seen[1] += len(text)
                yield text

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Copied:
        module, _, name = self.options["connect"].partition(":")
        started, seen = time.time_ns() // 1_000_000, [0, 0]
        sql = f"COPY {self.options['dbtable']} ({self.options['columns']}) FROM STDIN WITH (FORMAT csv, NULL 'null')"
        connection = getattr(importlib.import_module(module), name)(self.options.get("dsn", ""))
        try:
            cursor = connection.cursor()
            lines = self._lines(iterator, seen)
            if hasattr(cursor, "copy"):
                with cursor.copy(sql) as copy:
                    for text in lines:
                        copy.write(text)
            else:
                cursor.copy_expert(sql, io.BufferedReader(_Text(lines)))
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()
        return Copied(TaskContext.get().partitionId(), *seen, started, time.time_ns() // 1_000_000)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._store([m for m in messages if m])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Rows of tasks that had ended stay, as each task is a transaction of its own."""
        self._store([m for m in messages if m])

    def _store(self, reports: list[Copied]) -> None:
        # A process of the driver's own machine runs this; the driver reads the file next.
        with open(self.options["report"], "w") as f:
            f.writelines(json.dumps(asdict(r)) + "\n" for r in reports)


class CopySource(DataSource):
    """``df.write.format("linehaul_copy")``."""

    @classmethod
    def name(cls) -> str:
        return "linehaul_copy"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def copy_lines(
    lines: DataFrame, connect: str, table: str, columns: list[str], dsn: str = "", connections: int | None = None
) -> DataFrame:
    """Send copy text (a single column) to a table; ``(task, rows, bytes, started_ms, ended_ms, seconds)`` of each write task.

    Each task is one transaction. A task that fails is rolled back and tried again by Spark; when the job
    fails for good, what other tasks had sent stays, and the error is raised.
    ``connections`` bounds the tasks that send at a time.
    """
    spark = lines.sparkSession
    spark.dataSource.register(CopySource)
    if connections:
        lines = lines.repartition(connections)
    with tempfile.TemporaryDirectory() as own:
        report = os.path.join(own, "report")
        options = {"connect": connect, "dbtable": table, "columns": ", ".join(columns), "dsn": dsn, "report": report}
        lines.write.format(CopySource.name()).options(**options).mode("append").save()
        with open(report) as f:
            rows = [tuple(json.loads(line).values()) for line in f]
    done = spark.createDataFrame(rows, REPORT)
    return done.withColumn("seconds", (F.col("ended_ms") - F.col("started_ms")) / 1000)
