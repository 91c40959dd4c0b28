"""Running a micro-batch action with a trigger, a checkpoint and an error policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linehaul.session import log, work_scope
from linehaul.sinks.tables import keep_batch, read_batches
from linehaul.sinks.targets import Target

DROPPED_SCHEMA = "batch_id long, error string"
Dropped = tuple[int, str]


def run_stream(
    stream: DataFrame,
    action: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    on_error: str = "fail",
    drop_log: str | None = None,
    rows_log: str | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Start a query that calls ``action(batch, batch_id)`` for every micro-batch.

    The action writes the batch before it returns; folders that were staged for
    it are removed then.

    ``trigger`` holds the arguments of Spark's trigger, one second of
    processing time by default. With ``on_error='fail'`` an error stops the
    query and a restart from the checkpoint repeats the batch; with ``'drop'``
    the batch is given up, noted (in the log and, if named, below ``drop_log``)
    and the query goes on. ``rows_log`` names a folder that keeps the number of
    rows of each batch, counted while they pass, see :func:`batch_rows`.
    """
    if on_error not in ("fail", "drop"):
        raise ValueError("on_error must be 'fail' or 'drop'")
    spark = stream.sparkSession
    def run(batch: DataFrame, batch_id: int) -> None:
        seen = Observation() if rows_log else None
        if seen:
            batch = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
        try:
            with work_scope(spark):
                action(batch, batch_id)
            if seen:
                keep_batch(spark, rows_log, batch_id, "rows long", [(seen.get["rows"],)])
        except Exception as e:  # any failure of the batch is the policy's business
            if on_error == "fail":
                raise
            log.warning("dropped batch %s: %s", batch_id, e)
            if drop_log:
                note = spark.createDataFrame([(batch_id, str(e))], DROPPED_SCHEMA)
                note.coalesce(1).write.mode("overwrite").json(f"{drop_log}/{batch_id}")

    return (
        stream.writeStream.foreachBatch(run)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def write_stream(
    stream: DataFrame,
    target: Target,
    checkpoint: str,
    trigger: dict | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Start a query that writes to a target by Spark's own streaming sink, without any Python a batch.

    A file target keeps a log of committed batches beside its files: a batch that fails or is
    repeated shows its rows once, and readers of the folder see committed files only. A
    topic gets a repeated batch's messages again, as its sink is written at least once.
    """
    writer = stream.writeStream.format(target.fmt).options(**target.options)
    writer = writer.option("checkpointLocation", checkpoint).outputMode(output_mode)
    writer = writer.trigger(**(trigger or {"processingTime": "1 second"}))
    return writer.start(target.path) if target.path else writer.start()


def batch_rows(spark: SparkSession, rows_log: str) -> DataFrame:
    """``(batch_id, rows)`` of all non-empty batches that a query noted in ``rows_log``."""
    return read_batches(spark, rows_log, "rows long").filter("rows > 0").select("batch_id", "rows")
