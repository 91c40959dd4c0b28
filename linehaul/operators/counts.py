"""Counts per batch, running totals and load reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Batches per block of the running total.
BLOCK = 4096


def batch_counts(rows: DataFrame, batch: str, n: str = "count") -> DataFrame:
    """``(batch, count)`` of the batches that have rows."""
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias(n))


def with_empty_batches(
    counts: DataFrame, first: int, last: int, batch: str = "batch", n: str = "count"
) -> DataFrame:
    """Add a zero row for each batch number of ``first … last`` that is missing."""
    spine = counts.sparkSession.range(first, last + 1).withColumnRenamed("id", batch)
    return spine.join(counts, batch, "left").select(
        batch, F.coalesce(n, F.lit(0).cast("bigint")).alias(n)
    )


def running_total(
    counts: DataFrame, batch: str = "batch", n: str = "count", total: str = "total"
) -> DataFrame:
    """Add the total up to and including each batch.

    ``counts`` has one row per batch, numbered in time order. Totals run within
    blocks of batch numbers, in parallel; only one row per block goes through
    the single ordered pass that gives each block what came before it.
    """
    block = F.call_function("div", F.col(batch) - F.pmod(F.col(batch), F.lit(BLOCK)), F.lit(BLOCK))
    counts = counts.withColumn("_block", block)
    all_before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        counts.groupBy("_block")
        .agg(F.sum(n).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(all_before), F.lit(0)).alias("_before"))
    )
    so_far = (
        Window.partitionBy("_block")
        .orderBy(batch)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counts.withColumn("_within", F.sum(n).over(so_far))
        # An outer join puts no condition on the counts, so that both uses of
        # them have the same plan and the counting runs once.
        .join(blocks, "_block", "left")
        .withColumn(total, F.col("_before") + F.col("_within"))
        .drop("_block", "_within", "_before")
    )


def batch_report(
    rows: DataFrame, batch: str = "batch", ts_of_batch: str | None = None
) -> DataFrame:
    """``(ts, count, total)`` of the non-empty batches; ``ts`` is the batch number
    unless ``ts_of_batch`` gives an SQL expression over it."""
    report = running_total(batch_counts(rows, batch), batch)
    ts = F.expr(ts_of_batch) if ts_of_batch else F.col(batch)
    return report.select(ts.alias("ts"), "count", "total")


def load_report(
    spark: SparkSession,
    path: str,
    by: list[str] | None = None,
    started_ms: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Rows (and seconds from ``started_ms`` to the last file) per partition of a loaded table,
    or per write task, by the number that its files carry, where ``by`` names no columns.
    Copy text that is staged for a server's loader is such a table of text files.

    Taken from the files the load left behind: the row count needs no data
    column and the file times need no pass at all, so the load itself is not
    slowed down or run twice for its own report.
    """
    loaded = spark.read.format(fmt).load(path)
    if not by:
        task = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
        loaded, by = loaded.select(task.alias("task"), "_metadata"), ["task"]
    written = F.unix_millis(F.max(F.col("_metadata.file_modification_time")))
    measures = [F.count(F.lit(1)).alias("rows")]
    if started_ms is not None:
        measures.append(((written - F.lit(started_ms)) / 1000).alias("seconds"))
    return loaded.groupBy(*by).agg(*measures)


TASKS = "task int, rows long, bytes long, started_ms long, seconds double"
#: Tasks whose figures the driver keeps, as Spark's own bound on them does by default.
KEPT_TASKS = 100_000


def load_metrics(spark: SparkSession, load: Callable[[], None]) -> DataFrame:
    """Run a load; ``(task, rows, bytes, started_ms, seconds)`` of each of its write tasks.

    From the metrics that Spark's tasks send with their end, so nothing is read again. Beyond the number of
    tasks that Spark keeps, that is an error; :func:`load_report` has no such bound.
    """
    context = spark.sparkContext
    group, before = f"load-{uuid.uuid4().hex}", context.getLocalProperty("spark.jobGroup.id")
    context.setLocalProperty("spark.jobGroup.id", group)
    try:
        load()
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    mapper = spark._jvm.com.fasterxml.jackson.databind.ObjectMapper()
    mapper.registerModule(spark._jvm.com.fasterxml.jackson.module.scala.DefaultScalaModule())
    rows = []
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    for stage in sorted(stages):
        info = tracker.getStageInfo(stage)
        if info is None or not info.numCompletedTasks:
            continue  # skipped, as its shuffle was there already
        listed = scala.statusStore().taskList(stage, info.currentAttemptId, KEPT_TASKS)
        tasks = [t for t in json.loads(mapper.writeValueAsString(listed)) if t["status"] == "SUCCESS"]
        if len({t["index"] for t in tasks}) < info.numTasks:
            raise RuntimeError(f"figures of {info.numTasks - len(tasks)} tasks are gone")
        for t in tasks:
            out = t["taskMetrics"]["outputMetrics"]
            if out["recordsWritten"] or out["bytesWritten"]:
                rows.append((t["index"], out["recordsWritten"], out["bytesWritten"], t["launchTime"], t["duration"] / 1000))
    return spark.createDataFrame(rows, TASKS)


def load_total(report: DataFrame) -> DataFrame:
    """One row for the whole load: all rows, and the seconds of its slowest partition."""
    measures = [F.sum("rows").alias("rows")]
    if "seconds" in report.columns:
        measures.append(F.max("seconds").alias("seconds"))
    return report.agg(*measures)
