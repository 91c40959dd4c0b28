"""Tables stored by windows of write time: merged when a window is over, removed when its time is up.

Batches lie in folders, ``batch=B/window=W``. A list of the live folders is written anew with each change, under
the next number, and a reader takes the newest list: so it sees a change whole or not at all, and each
row once. Folders that no list of the last two names are deleted by ``clean``; until then readers that
started earlier still find them.

One writer at a time: whoever comes second to a number fails, and nothing is lost.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linehaul.functions.times import MINUTE_US, chunk_number
from linehaul.session import list_names, move, read_text, remove, write_text

WRITTEN = "written"


@dataclass(frozen=True)
class Listed:
    """What a list names: its number, the last batch and folders by window."""

    number: int = 0
    last_batch: int = -1
    folders: dict[int, list[str]] = field(default_factory=dict)


class WindowTable:
    """Rows of ``schema`` and the time they were written, in windows of ``interval_us``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, interval_us: int = 60 * MINUTE_US):
        self.spark, self.path, self.interval_us = spark, path, interval_us
        self.schema = StructType(list(schema)).add(WRITTEN, "timestamp")

    def listed(self) -> Listed:
        numbers = self._numbers()
        return self._list(numbers[-1]) if numbers else Listed()

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.path}/_lists") if n[0] != ".")

    def _list(self, number: int) -> Listed:
        kept = json.loads(read_text(self.spark, f"{self.path}/_lists/{number}.json"))
        return Listed(number, kept["last_batch"], {int(w): f for w, f in kept["folders"].items()})

    def _put(self, old: Listed, last_batch: int, folders: dict[int, list[str]]) -> None:
        number = old.number + 1
        aside = f"{self.path}/_lists/.{number}"
        write_text(self.spark, aside, json.dumps({"last_batch": last_batch, "folders": folders}))
        if number in self._numbers():
            raise OSError(f"{self.path} was changed by another writer")
        move(self.spark, aside, f"{self.path}/_lists/{number}.json")

    def _write(self, rows: DataFrame, folder: str) -> dict[int, list[str]]:
        """Rows by window, small windows in one file and large ones over several tasks."""
        rows = rows.withColumn("window", chunk_number(WRITTEN, self.interval_us)).hint("rebalance", "window")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("window").parquet(f"{self.path}/{folder}")
        names = [n for n in list_names(self.spark, f"{self.path}/{folder}") if n.startswith("window=")]
        return {int(n.removeprefix("window=")): [f"{folder}/{n}"] for n in names}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def append(self, rows: DataFrame, batch_id: int, written: str | Column | None = None) -> None:
        """Add a micro-batch, once however often it is tried; ``written`` is now unless given, and where it is null."""
        old = self.listed()
        if batch_id <= old.last_batch:
            return
        time = F.current_timestamp() if written is None else F.col(written) if isinstance(written, str) else written
        new = self._write(rows.withColumn(WRITTEN, F.coalesce(time.cast("timestamp"), F.current_timestamp())).select(*self.schema.names), f"batch={batch_id}")
        self._put(old, batch_id, {w: old.folders.get(w, []) + new.get(w, []) for w in {*old.folders, *new}})

    def read(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """The rows written in ``since <= written < until``; other windows are not opened."""
        low, high = (None if t is None else _micros(t) for t in (since, until))
        folders = self.listed().folders
        windows = [
            w
            for w in folders
            if (low is None or (w + 1) * self.interval_us > low) and (high is None or w * self.interval_us < high)
        ]
        rows = self._read([f for w in sorted(windows) for f in folders[w]])
        if since is not None:
            rows = rows.where(F.col(WRITTEN) >= F.lit(since))
        return rows if until is None else rows.where(F.col(WRITTEN) < F.lit(until))

    def compact(self, as_of: datetime) -> list[int]:
        """Merge the folders of every window that was over at ``as_of``, once; returns those windows."""
        old = self.listed()
        over = [w for w, f in old.folders.items() if (w + 1) * self.interval_us <= _micros(as_of) and len(f) > 1]
        if over:
            new = self._write(self._read([f for w in over for f in old.folders[w]]), f"merged={old.number + 1}")
            self._put(old, old.last_batch, old.folders | new)
        return sorted(over)

    def expire(self, as_of: datetime, ttl_seconds: int) -> list[int]:
        """Take out what was written ``ttl_seconds`` before ``as_of`` or earlier; returns the windows that
        went whole. Those are known from their numbers; only the window that the limit lies in is read."""
        if ttl_seconds < 0:
            return []
        old, limit = self.listed(), _micros(as_of - timedelta(seconds=ttl_seconds))
        gone = sorted(w for w in old.folders if (w + 1) * self.interval_us - 1 <= limit)
        left = {w: f for w, f in old.folders.items() if w not in gone}
        border = limit // self.interval_us
        if border in left:
            rows = self._read(left.pop(border)).where(F.unix_micros(WRITTEN) > limit)
            left |= self._write(rows, f"kept={old.number + 1}")
        if left != old.folders:
            self._put(old, old.last_batch, left)
        return gone

    def clean(self) -> list[str]:
        """Delete the folders that neither the newest list nor the one before names, and older lists."""
        numbers = self._numbers()
        named = {f for n in numbers[-2:] for folders in self._list(n).folders.values() for f in folders}
        deleted = []
        for top in list_names(self.spark, self.path):
            if top[0] in "._":
                continue
            inside = [f"{top}/{n}" for n in list_names(self.spark, f"{self.path}/{top}") if n.startswith("window=")]
            dead = [f for f in inside if f not in named]
            for f in [top] if len(dead) == len(inside) else dead:
                remove(self.spark, f"{self.path}/{f}")
            deleted += dead
        for n in numbers[:-2]:
            remove(self.spark, f"{self.path}/_lists/{n}.json")
        return deleted


def _micros(t: datetime) -> int:
    """Microseconds since 1970 of a time, UTC where it names no zone."""
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
