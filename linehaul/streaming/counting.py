"""Counting a topic batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linehaul.operators.counts import running_total
from linehaul.sinks.tables import keep_batch, read_batches
from linehaul.streaming.run import run_stream

COUNTS_SCHEMA = "ts long, count long"


def topic_total(stream: DataFrame) -> DataFrame:
    """Streaming ``(total)`` of all rows so far; the state store carries it over restarts.

    Write it in ``complete`` mode: every trigger that has data puts out the new total.
    """
    return stream.groupBy().agg(F.count(F.lit(1)).alias("total"))


def keep_totals(
    stream: DataFrame, totals_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Store ``(batch_id, total)`` at every micro-batch, those without rows included.

    The total lives in the state store, so it goes on over restarts and nothing is counted
    twice; only one row a batch leaves it.
    """
    spark = stream.sparkSession

    def store(total: DataFrame, batch_id: int) -> None:
        keep_batch(spark, totals_path, batch_id, "total long", [tuple(total.first())])

    return run_stream(topic_total(stream), store, checkpoint, trigger, output_mode="complete")


def stored_totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """``(batch_id, total)`` of every micro-batch that ran."""
    return read_batches(spark, totals_path, "total long").select("batch_id", "total")


def count_batches(
    stream: DataFrame, counts_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Store ``(ts, count)`` of every micro-batch; a repeated batch replaces its own row."""

    spark = stream.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        one = batch.agg(F.count(F.lit(1)), F.unix_millis(F.current_timestamp())).first()
        keep_batch(spark, counts_path, batch_id, COUNTS_SCHEMA, [(one[1], one[0])])

    return run_stream(stream, store, checkpoint, trigger)


def stored_report(
    spark: SparkSession, counts_path: str, empty_batches: bool = False
) -> DataFrame:
    """``(batch_id, ts, count, total)`` of the stored batches, by default the non-empty ones."""
    report = running_total(read_batches(spark, counts_path, COUNTS_SCHEMA), "batch_id")
    if not empty_batches:
        report = report.filter("count > 0")
    return report.select("batch_id", "ts", "count", "total").orderBy("batch_id")
