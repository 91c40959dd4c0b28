"""Keyed tables that stay cheap to read and to add to as they grow.

A keyed table is a bucketed Spark table: rows lie in buckets by a hash of their keys, so Spark reads
the current row of every key without a shuffle. A batch adds one file a bucket. Rows are never
changed in place: the row of the greatest arrival hides the others of its key, so a batch that
is added twice changes nothing, and neither does a file that stands beside the files it was
merged from.

Files of a bucket are merged level by level: a level holds files of about one size, and when it
holds ``fan`` of them they become one file of the next level. Large files are so rewritten seldom, and
buckets without new rows never.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from linehaul.operators.keyed import latest_by_key
from linehaul.session import hadoop_path, new_work_folder, remove
from linehaul.sinks.tables import conform

#: Bytes up to which a file is of the lowest level.
LEVEL_BYTES = 1 << 20


@dataclass(frozen=True)
class KeyedTable:
    """A table of ``schema`` below ``path`` with ``keys``; ``buckets`` stays as it was at first.

    ``arrival`` orders the rows of a key. The session's catalog only holds the table's
    description, which every session gives anew; the rows are the files.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    arrival: str | Column
    buckets: int = 64

    @property
    def name(self) -> str:
        return f"keyed_{hashlib.md5(self.path.encode()).hexdigest()}"

    def __post_init__(self):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _insert(self, rows: DataFrame) -> None:
        # Dealt out as the buckets are, so that every task writes one bucket's file.
        rows.repartition(self.buckets, *self.keys).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def add(self, rows: DataFrame) -> None:
        """Add a batch, its rows of one key reduced to the last."""
        self._insert(latest_by_key(conform(rows, self.schema), list(self.keys), self.arrival))

    def current(self) -> DataFrame:
        """The last row of every key, without a shuffle."""
        return latest_by_key(self.spark.table(self.name), list(self.keys), self.arrival)

    def files(self) -> dict[int, list[tuple[int, str]]]:
        """Sizes and names of the files by bucket."""
        fs, root = hadoop_path(self.spark, self.path)
        found: dict[int, list[tuple[int, str]]] = {}
        for s in fs.listStatus(root) if fs.exists(root) else []:
            name = s.getPath().getName()
            bucket = re.search(r"_(\d+)(?:\..*)?$", name)
            if bucket and name[0] not in "._":
                found.setdefault(int(bucket[1]), []).append((s.getLen(), name))
        return found

    def compact(self, fan: int = 4) -> int:
        """Merge the levels that are full; returns the number of buckets rewritten.

        The merged file is added before the files it stands for are deleted, so a stop in between loses
        nothing and readers that start at any time get every key's last row. A reader
        that was under way when files went has to read again.
        """
        full: list[list[str]] = []
        for files in self.files().values():
            levels: dict[int, list[str]] = {}
            for size, name in files:
                level, most = 0, LEVEL_BYTES
                while size > most:
                    level, most = level + 1, most * fan
                levels.setdefault(level, []).append(name)
            full += [names for names in levels.values() if len(names) >= fan]
        if not full:
            return 0
        old = [f"{self.path}/{n}" for names in full for n in names]
        rows = self.spark.read.schema(self.schema).parquet(*old)
        # Written aside first, as a table can't be read and added to in one job.
        aside = new_work_folder(self.spark, "merged")
        latest_by_key(rows, list(self.keys), self.arrival).write.parquet(aside)
        self._insert(self.spark.read.schema(self.schema).parquet(aside))
        for file in old:
            remove(self.spark, file)
        remove(self.spark, aside)
        self.spark.catalog.refreshTable(self.name)
        return len(full)

    def forget(self) -> None:
        """Take the description out of the catalog; the rows stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
