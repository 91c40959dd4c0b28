"""Approximate nearest neighbours by counting collisions on single projections.

Vectors are spread evenly over shards by a hash of their id. A shard projects its vectors
on ``PROJECTIONS`` directions and keeps, per direction, one sorted array of values. A query
opens a window centred on its own value in each array; windows grow with a search radius
(virtual rehashing: no table is rebuilt, only the ends move outward), and every vector that
comes in gets one collision. The first radius comes from a query's distances to a few
vectors of the shard; any would do, as the search goes on until its end is reached. Vectors that reach the collision threshold are verified by
their true distance. A vector within the radius falls into a window with a known chance,
so the threshold lies ``SPREAD`` standard deviations below the mean of its collisions;
the search of a shard ends when its k-th verified distance is within the radius, or when
all windows cover all values. No cap is set on collisions or candidates.

A task holds one shard, whose arrays are made once, and the blocks of queries stream past it; both are of
bounded size. Per query and shard at most k rows leave a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without an id. Vectors are compared with those of their own
length only. Repeated ids count once, at their smallest distance. Equal distances go to the
smaller id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.llm.shards import against
from linehaul.llm.stage import small_batches

#: Vectors of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_ROWS = 8192, 4096
PROJECTIONS = 128
#: Half a window's width and the growth of the radius from level to level.
WIDTH, GROWTH = 1.5, 1.03
#: Vectors of a shard whose distances set a query's first radius: the k-th of theirs over this.
SAMPLE, START = 256, 1.15
#: Standard deviations between the mean collisions of a vector at the radius and the threshold.
SPREAD = 1.5
SEED = 7

_OUT = "query_id bigint, vec_id bigint, score double"


def _directions(size: int) -> np.ndarray:
    """Directions in groups that stand at right angles, as long as Gaussian ones on average."""
    rng = np.random.default_rng(SEED)
    found = []
    while sum(x.shape[1] for x in found) < PROJECTIONS:
        found.append(np.linalg.qr(rng.normal(size=(size, size)))[0] * sqrt(size))
    return np.concatenate(found, 1)[:, :PROJECTIONS]


class Shard:
    """The sorted arrays of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        #: True distances computed so far.
        self.verified = 0
        self.directions = _directions(vectors.shape[1])
        values = vectors @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.sort(values, axis=0).T.copy()
        inside = erf(WIDTH / sqrt(2))
        mean, deviation = PROJECTIONS * inside, sqrt(PROJECTIONS * inside * (1 - inside))
        self.threshold = int(mean - SPREAD * deviation)
        n = len(ids)
        near = self.values[:, min(n - 1, n // 2 + max(1, n // 50))] - self.values[:, n // 2]
        self.first = max(float(np.median(near)), 1e-9)
        self.sample = np.unique(np.linspace(0, n - 1, min(n, SAMPLE)).astype(int))

    def nearest(self, query_id: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest vectors found."""
        n = len(self.ids)
        centre = vector @ self.directions
        hits = np.zeros(n, np.int16)
        low = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre)])
        high = low.copy()
        checked = self.ids == query_id
        own = int(checked.sum())
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        some = self.sample[self.ids[self.sample] != query_id]
        far = np.sort(np.sqrt(((self.vectors[some] - vector) ** 2).sum(1)))
        radius = max(self.first, far[k - 1] / START if len(far) >= k else 0.0)
        while True:
            half = radius * WIDTH
            for j in range(PROJECTIONS):
                v, order = self.values[j], self.order[j]
                a, b = v.searchsorted(centre[j] - half), v.searchsorted(centre[j] + half, "right")
                hits[order[a : low[j]]] += 1
                hits[order[high[j] : b]] += 1
                low[j], high[j] = a, max(b, high[j])
            whole = bool((low == 0).all() and (high == n).all())
            new = np.flatnonzero(~checked & ((hits >= self.threshold) | whole))
            if len(new):
                checked[new] = True
                self.verified += len(new)
                far = np.sqrt(((self.vectors[new] - vector) ** 2).sum(1))
                ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, far])
                ids, scores = _smallest(ids, scores, k)
            if whole or len(ids) + own >= n or (len(ids) >= k and scores[-1] <= radius):
                return ids, scores
            radius *= GROWTH


def _smallest(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest by score and id, an id once."""
    order = np.lexsort([ids, scores])
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], scores[order]


def _shard(rows: pd.DataFrame) -> Shard:
    return Shard(rows["id"].to_numpy(), np.stack(rows["vector"].to_list()).astype(np.float64))


def _search(k: int) -> Callable[[Shard, pd.DataFrame], pd.DataFrame]:
    def search(shard: Shard, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for q, vector in zip(queries["id"], queries["vector"]):
            ids, scores = shard.nearest(q, np.asarray(vector, np.float64), k)
            parts.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}))
        return pd.concat(parts)

    return search


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every row that ``queries`` (a
    condition on the column ``id``) names, its own id left out."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
    rows = rows.withColumn("size", F.size("vector"))
    asked = rows.where(queries)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).first()
    shards, blocks = -(-counts["n"] // SHARD_ROWS) or 1, -(-counts["q"] // BLOCK_ROWS) or 1
    block = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).alias("block")
    asked = asked.select("id", "size", "vector", block, F.lit(0).alias("place"))
    found = against(rows, asked, shards, _shard, _search(k), _OUT)
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
