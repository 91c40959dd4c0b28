"""File tables: recreate, append, chunked and clustered layouts, batches written once."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linehaul.functions.times import WEEK_US
from linehaul.operators.keyed import CHUNK, clustered, latest_by_key, with_chunk
from linehaul.session import hadoop_path, write_text


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a target table, by name, in its order and with its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def recreate(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> None:
    """Drop what is at the path and leave an empty table of the given schema."""
    spark.createDataFrame([], schema).write.format(fmt).mode("overwrite").save(path)


def append(
    df: DataFrame,
    path: str,
    schema: StructType | None = None,
    recreate_first: bool = False,
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Add rows to a table; with ``recreate_first`` they replace it."""
    if schema is not None:
        df = conform(df, schema)
    writer = df.write.format(fmt).mode("overwrite" if recreate_first else "append")
    if recreate_first:  # all partitions go, whatever the session's mode
        writer = writer.option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_chunked(
    df: DataFrame, path: str, ts: str, interval_us: int = WEEK_US, recreate_first: bool = False
) -> None:
    """Write with one folder per time chunk.

    Rows are rebalanced by chunk: small chunks end up in one file, a chunk that
    holds a large share of the rows is split over several tasks at run time. The
    folder's name holds the interval, so readers need not be told.
    """
    name = f"{CHUNK}{interval_us}"
    rows = with_chunk(df, ts, interval_us).hint("rebalance", name)
    append(rows, path, recreate_first=recreate_first, partition_by=[name])


def write_clustered(
    df: DataFrame,
    path: str,
    key: str,
    ts: str,
    tie_breakers: list[str] | None = None,
    recreate_first: bool = False,
    partitions: int | None = None,
) -> None:
    """Write in key order, newest first within a key (see :func:`clustered`)."""
    append(
        clustered(df, key, ts, tie_breakers, partitions), path, recreate_first=recreate_first
    )


def read_keyed(
    spark: SparkSession, path: str, keys: list[str], arrival: str | Column
) -> DataFrame:
    """The current rows of a table that is only ever appended to.

    Writing stays a plain append; a later row of the same key hides the earlier
    one when the table is read.
    """
    return latest_by_key(spark.read.parquet(path), keys, arrival)


def write_batch_once(df: DataFrame, batch_id: int, path: str, fmt: str = "parquet") -> None:
    """Write a micro-batch to a folder of its own, replacing what a failed try left there."""
    df.write.format(fmt).mode("overwrite").save(f"{path}/batch_id={batch_id}")


# Batches of one folder of a batch log.
LOG_BATCHES = 1000


def keep_batch(
    spark: SparkSession, path: str, batch_id: int, schema: str, rows: list[tuple]
) -> None:
    """Note a few values of a micro-batch, without a job; a repeated batch replaces its own note.

    Notes lie one folder a batch at first. When a block of ``LOG_BATCHES`` is over, they are
    put into one folder, so a log of any age has few folders.
    """
    names = StructType.fromDDL(schema).names
    lines = [json.dumps(dict(zip(names, row)) | {"batch_id": batch_id}) for row in rows]
    write_text(spark, f"{path}/batch={batch_id}/note.json", "\n".join(lines))
    block = batch_id // LOG_BATCHES - 1
    if block >= 0 and batch_id % LOG_BATCHES == 1:
        _merge_block(spark, path, block, schema)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All notes of a batch log, a batch once."""
    fields = f"{schema}, batch_id long"
    try:
        notes = spark.read.schema(fields).option("recursiveFileLookup", "true").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)
    # While a block is being put together its notes lie there twice, with equal values.
    return notes.dropDuplicates(["batch_id"])


def _merge_block(spark: SparkSession, path: str, block: int, schema: str) -> None:
    """Put the notes of a block into one folder, then delete what they were read from.

    A try that was stopped leaves a folder of the block and some of the single notes, and
    either may hold the only copy of a note. So both are read, and nothing is written over.
    """
    fs, root = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    end = (block + 1) * LOG_BATCHES
    tries = [n for n in names if n.split(".")[0] == f"block={block}"]
    old = tries + [n for n in names if n.startswith("batch=") and int(n[6:]) < end]
    if len(old) == len(tries) < 2:
        return
    last = max((int(n.partition(".")[2] or 0) for n in tries), default=None)
    name = f"block={block}" if last is None else f"block={block}.{last + 1}"
    reader = spark.read.schema(f"{schema}, batch_id long").option("recursiveFileLookup", "true")
    notes = reader.json([f"{path}/{n}" for n in old]).dropDuplicates(["batch_id"])
    notes.coalesce(1).write.json(f"{path}/{name}")
    for n in old:
        fs.delete(hadoop_path(spark, f"{path}/{n}")[1], True)


def compact_keyed(
    spark: SparkSession,
    path: str,
    target: str,
    keys: list[str],
    arrival: str | Column,
    through: int,
) -> None:
    """Write the current rows of a keyed table of batches up to ``through`` to a new place.

    There they are the batch ``through``, in as many files as their size needs;
    readers change to ``target`` and later batches are written there.
    """
    batches = spark.read.parquet(path).filter(F.col("batch_id") <= through)
    current = latest_by_key(batches, keys, arrival).drop("batch_id")
    write_batch_once(current, through, target)
