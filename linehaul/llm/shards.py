"""Rows of a query set against all rows: candidates are held shard by shard while queries stream past."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _streamed(build: Callable, search: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sorted rows of shards: the candidates of a length are held while blocks of queries pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        waiting: list[pd.DataFrame] = []
        shard = None

        def done() -> Iterator[pd.DataFrame]:
            """The rows that wait are complete: candidates become the shard, queries are searched for."""
            nonlocal shard
            rows = pd.concat(waiting, ignore_index=True) if waiting else pd.DataFrame()
            waiting.clear()
            if at and at[2] < 0:
                shard = build(rows)
            elif at and shard is not None:
                found = search(shard, rows)
                if len(found):
                    yield found

        for frame in frames:
            for key, part in frame.groupby(["shard", "size", "block"], sort=True):
                if key != at:
                    yield from done()
                    if at and key[:2] != at[:2]:
                        shard = None
                    at = key
                waiting.append(part)
        yield from done()

    return run


def against(rows: DataFrame, queries: DataFrame, shards: int, build: Callable, search: Callable, schema: str) -> DataFrame:
    """What ``search(build(candidates), queries)`` gives for every block of queries against every shard.

    ``rows`` has ``id``, ``size`` and what a candidate needs; ``queries`` has ``block`` (from 0),
    ``place`` (the order within a block) and more. Candidates are shuffled once, queries once per shard, and
    a task holds one shard and one block. Only rows of one ``size`` meet.
    """
    stand_in = {"block": -1, "place": 0, "parent": -1, "edge": 0}
    none = {c: F.lit(stand_in.get(c)).cast(t).alias(c) for c, t in queries.dtypes if c not in rows.columns}
    base = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), *[none.get(c, F.col(c)) for c in queries.columns])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    every = base.union(queries.select(each, *queries.columns))
    dealt = every.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "size", "block", "place")
    return dealt.mapInPandas(_streamed(build, search), schema)
