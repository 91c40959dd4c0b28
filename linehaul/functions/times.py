"""Time helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COPY_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
WEEK_US = 604_800_000_000
MINUTE_US = 60_000_000


def format_epoch_ms(ms: str | Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss.SSS`` in the session zone (pinned to UTC)."""
    return F.date_format(F.timestamp_millis(ms), COPY_TIME_FORMAT)


def chunk_number(ts: str | Column, interval_us: int = WEEK_US) -> Column:
    """Index of the fixed-length time chunk a timestamp falls in, counted from the epoch."""
    if interval_us <= 0:
        raise ValueError("interval_us must be positive")
    us = F.unix_micros(ts)
    # Cut down to the chunk start first, so that times before the epoch round down too.
    return F.call_function("div", us - F.pmod(us, F.lit(interval_us)), F.lit(interval_us))
