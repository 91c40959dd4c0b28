"""Hard negatives: rows of another label that score just below an anchor's positives.

Anchors are dealt into blocks of near neighbours (by the closest of a few pivots, cut by range) and each
block is spanned by a tree of least distances. A candidate's score at an anchor is its score at
the anchor's parent, plus or minus their distance times the candidate's norm; where the
parent's score was never computed, its own bounds widen by as much. A task holds one shard of
candidates, and the blocks of anchors stream past it. It walks each tree from the root, whose scores are all
computed, and computes a score below it only where the bounds meet a window: for positives, what may
still enter the first ``n_positives`` (given those found and all lower bounds); for negatives, the span between the
shares of each positive's score, above what it has already found there. The bounds are true for any
vectors, so the result is exact; how much they save depends on how close the anchors stand.

Scores are inner products of integer components and never rounded: blocks and shards whose sums
stay below 2 ** 53 are multiplied as doubles, others as integers of any size.

Candidates are shuffled once, anchors once per shard; a task holds one shard and one block, both
of bounded size. Per anchor and shard it returns at
most the wanted positives, then at most ``n_negatives`` a positive; what is asked of the
driver are two counts and the pivots, which are bounded.

Defined results: rows without an id, a label or a vector, or with a component that is null or not finite
(also after scaling), take no part. Of repeated ids the row of the smallest label and vector counts. Vectors
meet those of their own length only (without components all score 0). Scores beyond a 64-bit
integer are returned as its ends. Equal scores go to the smaller id. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linehaul.llm.shards import against
from linehaul.llm.stage import staged

#: Candidates of a shard and anchors of a block, about; candidates bounded at once within a task.
SHARD_ROWS, BLOCK_ROWS, CHUNK_ROWS = 16384, 512, 2048
#: Anchors that others are compared with to bring near ones together.
PIVOTS = 64
#: Components are floored after multiplication by this.
SCALE = 256
_LONG = 2**63

_TREE = "id bigint, label bigint, vector array<double>, size int, block bigint, place int, parent int, edge double"
_POSITIVES = "anchor bigint, id bigint, score bigint"
_NEGATIVES = "anchor bigint, positive bigint, positive_score bigint, id bigint, score bigint"


def usable_rows(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """``(id, label, vector, size)``: the rows that take part, floored components, an id once."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("bigint").alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    # Doubles of that size are whole already, and `floor` of SQL would overflow.
    whole = F.transform("row.vector", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return one.select("id", "row.label", whole.alias("vector"), F.size("row.vector").alias("size"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices as doubles where no sum of products can lose a digit, else as Python integers."""
    top = 1.0
    for m in matrices:
        top *= float(np.abs(m).max(initial=1))
    if top * max(matrices[0].shape[1], 1) < 2**52:
        return list(matrices)
    whole = np.frompyfunc(int, 1, 1)
    return [whole(m) for m in matrices]


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order from the first vector outward, parent (-1 for the first) and distance to it."""
    n = len(vectors)
    parent, edge = np.full(n, -1), np.full(n, np.inf)
    edge[0] = 0
    open_, order = np.ones(n, bool), []
    for _ in range(n):
        k = int(np.argmin(np.where(open_, edge, np.inf))) if np.isfinite(edge[open_]).any() else int(np.flatnonzero(open_)[0])
        open_[k] = False
        order.append(k)
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.sqrt(((vectors - vectors[k]) ** 2).sum(1))
        nearer = open_ & (far < edge)
        edge[nearer], parent[nearer] = far[nearer], k
    return np.array(order), parent, edge


def _planted(limit: int, pivots: np.ndarray) -> tuple[Callable, Callable]:
    """Cells of anchors by pivot, and the trees of a partition's anchors."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near = [int(np.argmax(pivots @ np.asarray(v))) if len(v) == pivots.shape[1] else -1 for v in f["vector"]]
            yield f.assign(cell=near)

    def trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 20
        held = list(frames)
        every = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"size": []})
        for _, same in every.groupby("size", sort=True):
            same = same.sort_values(["cell", "id"])
            for k in range(0, len(same), limit):
                part = same.iloc[k : k + limit]
                order, parent, edge = spanning_tree(_matrix(part["vector"]))
                place = np.empty(len(part), int)
                place[order] = np.arange(len(part))
                above = np.where(parent < 0, -1, place[parent])
                out = part.drop(columns="cell").assign(block=block, place=place, parent=above, edge=edge)
                yield out[["id", "label", "vector", "size", "block", "place", "parent", "edge"]]
                block += 1

    return cells, trees


def anchor_trees(spark: SparkSession, anchors: DataFrame) -> DataFrame:
    """The anchors with their block and their place, parent and edge in its tree."""
    n = anchors.count()
    blocks = -(-n // BLOCK_ROWS) or 1
    some = anchors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vector", "size").collect()
    size = max((r["size"] for r in some), default=0)
    pivots = np.array([r["vector"] for r in some if r["size"] == size]).reshape(-1, size) if some else np.zeros((1, 0))
    cells, trees = _planted(2 * BLOCK_ROWS, pivots)
    schema = "id bigint, label bigint, vector array<double>, size int"
    near = anchors.mapInPandas(cells, schema + ", cell int")
    return near.repartitionByRange(blocks, "size", "cell", "id").mapInPandas(trees, _TREE)


def _range(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles below and above scores, which may be integers of any size."""
    if scores.dtype != object:
        return scores, scores
    near = np.array([float(s) if abs(s) < 10**300 else np.inf for s in scores])
    off = np.abs(near) * 1e-15
    return np.where(np.isinf(near), -np.inf, near - off), near + off


class Shard:
    """Candidates of one length, in the order of their ids."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("id", ignore_index=True)
        self.ids, self.labels, self.vectors = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["vector"])
        with np.errstate(over="ignore"):
            # A little more than the rounding of the bounds' own sums.
            self.norms = np.sqrt((self.vectors**2).sum(1)) * (1 + 1e-9)


class Walk:
    """One block against one shard: bounds along the tree, scores where they are asked for."""

    def __init__(self, shard: Shard, anchors: pd.DataFrame):
        self.shard = shard
        self.own, self.labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        self.parents, self.edges = anchors["parent"].to_numpy(), anchors["edge"].to_numpy() * (1 + 1e-9)
        self.a, self.c = _exact(_matrix(anchors["vector"]), shard.vectors)
        #: Scores computed, and pairs there are.
        self.computed, self.pairs = 0, len(self.own) * len(shard.ids)

    def run(
        self,
        wanted: Callable[[int, slice], np.ndarray],
        window: Callable[[int, np.ndarray], tuple[float, float]],
        take: Callable[[int, np.ndarray, np.ndarray], None],
    ) -> None:
        """For every anchor, from the root: ``take`` the places of candidates that are ``wanted`` and whose bounds
        meet the anchor's window, with their scores. A window may look at the lower bounds of the wanted."""
        n = len(self.shard.ids)
        for start in range(0, n, CHUNK_ROWS):
            rows = slice(start, min(n, start + CHUNK_ROWS))
            norms = self.shard.norms[rows]
            low, high = np.zeros((2, len(self.own), len(norms)))
            for k, p in enumerate(self.parents):
                mine = wanted(k, rows)
                if p < 0:
                    at = np.arange(len(norms))
                else:
                    with np.errstate(invalid="ignore", over="ignore"):
                        reach = np.nan_to_num(self.edges[k] * norms, nan=np.inf, posinf=np.inf)
                    low[k], high[k] = low[p] - reach, high[p] + reach
                    bottom, top = window(k, low[k, mine])
                    at = np.flatnonzero(mine & ~(high[k] < bottom) & ~(low[k] > top))
                if not len(at):
                    continue
                scores = self.c[rows][at] @ self.a[k]
                low[k, at], high[k, at] = _range(scores)
                self.computed += len(at)
                take(k, at[mine[at]] + start, scores[mine[at]])


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id (``ids`` rise)."""
    if len(scores) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort([ids[some], -scores[some]])[:k]]
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))
    return np.array(order[:k], int)


class Best:
    """The first k rows found, by score and id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        keep = _first(ids, scores, self.k)
        self.ids, self.scores = ids[keep], scores[keep]

    @property
    def least(self) -> float:
        """What a further row has to reach: the last score, as ties go to smaller ids."""
        return float(self.scores[-1]) if len(self.ids) >= self.k else -np.inf


    def columns(self) -> dict[str, list[int]]:
        """Ids and scores found; scores within a long."""
        return {"id": self.ids.tolist(), "score": [max(-_LONG, min(_LONG - 1, int(s))) for s in self.scores]}


def _positives(k: int) -> Callable[[Shard, pd.DataFrame], pd.DataFrame]:
    def search(shard: Shard, anchors: pd.DataFrame) -> pd.DataFrame:
        walk = Walk(shard, anchors)
        best = [Best(k) for _ in walk.own]
        walk.run(
            lambda a, rows: (shard.labels[rows] == walk.labels[a]) & (shard.ids[rows] != walk.own[a]),
            # As many as are asked for score no less than the k-th lower bound.
            lambda a, low: (max(best[a].least, np.partition(low, -k)[-k] if len(low) >= k else -np.inf), np.inf),
            lambda a, rows, scores: best[a].add(shard.ids[rows], scores),
        )
        return pd.concat([pd.DataFrame({"anchor": a} | b.columns()) for a, b in zip(walk.own.tolist(), best)])

    return search


@dataclass
class Span:
    """Scores from ``bottom`` to ``top`` belong to a positive."""

    positive: int
    score: int
    bottom: int
    top: int
    best: Best


def _negatives(k: int, low: int, high: int) -> Callable[[Shard, pd.DataFrame], pd.DataFrame]:
    def span(positive) -> Span:
        # low * positive <= 100 * negative <= high * positive, in whole numbers.
        score = int(positive["score"])
        return Span(int(positive["id"]), score, -(-low * score // 100), high * score // 100, Best(k))

    def search(shard: Shard, anchors: pd.DataFrame) -> pd.DataFrame:
        walk = Walk(shard, anchors)
        spans = [[span(p) for p in ps] for ps in anchors["positives"]]

        def window(a: int, _: np.ndarray) -> tuple[float, float]:
            bottom = min((max(s.bottom, s.best.least) for s in spans[a]), default=np.inf)
            return float(bottom), max((float(s.top) for s in spans[a]), default=-np.inf)

        def take(a: int, rows: np.ndarray, scores: np.ndarray) -> None:
            for s in spans[a]:
                fits = ((scores >= s.bottom) & (scores >= s.best.least) & (scores <= s.top)).astype(bool)
                if fits.any():
                    s.best.add(shard.ids[rows[fits]], scores[fits])

        walk.run(lambda a, rows: shard.labels[rows] != walk.labels[a], window, take)
        found = [
            pd.DataFrame({"anchor": a, "positive": s.positive, "positive_score": s.score} | s.best.columns())
            for a, of_anchor in zip(walk.own.tolist(), spans)
            for s in of_anchor
        ]
        return pd.concat(found) if found else pd.DataFrame()

    return search


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(anchor, positive, rank, negative, positive_score, negative_score)``.

    Anchors are the rows that ``anchors`` (a condition on the column ``id``) names; ``label``
    is an expression on the given columns. A negative scores from ``low`` to ``high`` percent of the positive.
    """
    rows = staged(usable_rows(vectors, label, id_col, vector_col), "rows")
    trees = staged(anchor_trees(rows.sparkSession, rows.where(anchors)), "trees")
    shards = -(-rows.count() // SHARD_ROWS) or 1

    found = against(rows, trees, shards, Shard, _positives(n_positives), _POSITIVES)
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    positives = found.withColumn("nth", first).where(F.col("nth") <= n_positives)
    listed = positives.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asked = staged(trees.join(listed, "id", "left").withColumn("positives", F.coalesce("positives", F.array())), "asked")

    found = against(rows, asked, shards, Shard, _negatives(n_negatives, low, high), _NEGATIVES)
    place = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))
    return (
        found.withColumn("rank", place)
        .where(F.col("rank") <= n_negatives)
        .select("anchor", "positive", "rank", F.col("id").alias("negative"), "positive_score", F.col("score").alias("negative_score"))
    )


def negative_report(embeddings: DataFrame) -> DataFrame:
    """Every 50th row's hard negatives; the label of every 7th row is taken to be the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives(embeddings, F.col("id") % 50 == 0, label)
    return out.toDF("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
