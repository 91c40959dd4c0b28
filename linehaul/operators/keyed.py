"""What a keyed, time-chunked store does to rows, as DataFrame operations."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.functions.ids import row_hash
from linehaul.functions.times import WEEK_US, chunk_number


def latest_by_key(df: DataFrame, keys: list[str], arrival: str | Column) -> DataFrame:
    """The row with the greatest ``arrival`` of each key.

    A row without arrival comes before all others, and of rows that arrived
    together the one of the greatest row hash counts, so that some real row
    wins, the same one on every try.

    An aggregate, so each task first keeps one row per key of its own; a key
    that holds a large share of all rows is down to one row per task before
    the shuffle. Spark sorts each task's rows by key for it, since the kept
    row is not of a fixed width.
    """
    rest = [c for c in df.columns if c not in keys]
    arrived = F.col(arrival) if isinstance(arrival, str) else arrival
    order = F.struct(arrived.isNotNull(), arrived, row_hash(df))
    last = F.max_by(F.struct(*rest), order)
    return (
        df.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*").select(*df.columns)
    )


def clustered(
    df: DataFrame,
    key: str,
    ts: str,
    tie_breakers: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Rows laid out by key, newest first within a key.

    Ranges are cut on key and time together, and at last on a hash of the row:
    rows of one key stay next to each other, yet a very frequent key spreads
    over tasks.
    """
    ties = [F.col(c).asc() for c in tie_breakers or []]
    order = [F.col(key).asc(), F.col(ts).desc(), *ties, row_hash(df).asc()]
    ranged = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    )
    return ranged.sortWithinPartitions(*order)


CHUNK = "chunk_"


def with_chunk(df: DataFrame, ts: str, interval_us: int = WEEK_US) -> DataFrame:
    """Add the chunk number in a column that is named after the interval, which so stays
    with the table."""
    return df.withColumn(f"{CHUNK}{interval_us}", chunk_number(ts, interval_us))


def chunk_interval(chunked: DataFrame) -> int:
    """The interval in microseconds that a chunked table was written with."""
    found = [c for c in chunked.columns if re.fullmatch(rf"{CHUNK}\d+", c)]
    if len(found) != 1:
        raise ValueError(f"one chunk column is needed, found {found}")
    return int(found[0].removeprefix(CHUNK))


def in_time_range(
    chunked: DataFrame,
    ts: str,
    since: datetime,
    until: datetime,
) -> DataFrame:
    """Rows with ``since <= ts < until``; the chunk bounds let whole chunks be skipped."""
    interval_us = chunk_interval(chunked)
    name = f"{CHUNK}{interval_us}"
    low, high = F.lit(since), F.lit(until)
    return chunked.filter(
        (F.col(name) >= chunk_number(low, interval_us))
        & (F.col(name) <= chunk_number(high, interval_us))
        & (F.col(ts) >= low)
        & (F.col(ts) < high)
    )


def retained(df: DataFrame, ts: str, as_of: datetime, ttl_seconds: int = -1) -> DataFrame:
    """Rows that have not outlived ``ttl_seconds`` at ``as_of``; a negative time keeps all."""
    if ttl_seconds < 0:
        return df
    return df.filter(F.col(ts) > F.lit(as_of - timedelta(seconds=ttl_seconds)))
