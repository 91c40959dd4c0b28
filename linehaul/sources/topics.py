"""Message topics as streaming or batch DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_options(
    brokers: str,
    topics: str,
    start: str = "latest",
    group: str | None = None,
    min_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """Source options. ``topics`` is one name or a comma list.

    Without ``group`` Spark makes a fresh consumer group per query. A start
    position holds for the first run only; later runs go on from the
    checkpoint. ``min_partitions`` asks for more parallel readers than the
    topics have partitions.
    """
    if start not in ("latest", "earliest"):
        raise ValueError("start must be 'latest' or 'earliest'")
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topics,
        "startingOffsets": start,
        "kafka.group.id": group,
        "minPartitions": None if min_partitions is None else str(min_partitions),
    }
    options.update(extra or {})
    return {k: v for k, v in options.items() if v is not None}


def read_topic(
    spark: SparkSession,
    options: dict[str, str],
    streaming: bool = True,
    source: str = "kafka",
) -> DataFrame:
    """``(key, value, topic, partition, offset, timestamp)``, key and value as text."""
    if not streaming:
        # A batch read needs a finite range: everything there is right now.
        # Offsets that the caller gave stay; "latest" is a stream's default start.
        given = {k: v for k, v in options.items() if (k, v) != ("startingOffsets", "latest")}
        options = {"startingOffsets": "earliest", "endingOffsets": "latest"} | given
    reader = spark.readStream if streaming else spark.read
    records = reader.format(source).options(**options).load()
    return records.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def values(records: DataFrame, name: str = "line") -> DataFrame:
    """The message text alone."""
    return records.select(F.col("value").cast("string").alias(name))
