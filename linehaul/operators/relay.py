"""Moving messages: union of topics, replay, relay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_streams(streams: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, matched by column name, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b), streams)


def replay(lines: DataFrame, times: int, value: str = "line") -> DataFrame:
    """``times`` messages per line, each under a fresh random key.

    Copies are made in place, row by row; nothing is joined or shuffled.
    """
    if times < 0:
        raise ValueError("times must not be negative")
    if times == 0:
        lines, times = lines.filter(F.lit(False)), 1
    copies = F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy")
    kept = [c for c in lines.columns if c != value]
    return lines.select(*kept, value, copies).select(
        *kept,
        "copy",
        F.expr("uuid()").alias("key"),
        F.col(value).alias("value"),
    )


def relay_messages(messages: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Messages as they came, key and value as text, ready for a topic."""
    return messages.select(
        F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")
    )
