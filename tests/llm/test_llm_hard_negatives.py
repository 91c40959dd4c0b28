from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from linehaul.llm import hard_negatives as hard
from linehaul.llm.stage import small_batches
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<double>"


def expected(rows: list[tuple], is_anchor) -> list[tuple]:
    """(id, label, vector) to the rows by comparing all."""
    usable = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: (r[0], r[1], str(r[2]))):
        if all(x is not None and math.isfinite(x * 256) for x in v):
            usable.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (mine, v) in usable.items():
        if not is_anchor(a):
            continue
        scores = [(-sum(p * q for p, q in zip(v, w)), i, label) for i, (label, w) in usable.items() if len(w) == len(v)]
        for s, p, label in sorted(x for x in scores if x[2] == mine and x[1] != a)[:5]:
            fits = sorted(x for x in scores if x[2] != mine and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def got(spark, rows: list[tuple]) -> list[tuple]:
    df = small_batches(spark).createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("id", "size", "block", "place", "shard", "score", "vector")})
    return sorted(tuple(r) for r in hard.hard_negatives(df, F.col("id") % 5 == 0, F.col("label")).select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect())


def clustered(seed: int, n: int = 240, size: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    return [(i, int(rng.integers(0, 3)), (centres[rng.integers(0, 4)] + rng.normal(scale=0.02, size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard, block", [(10**6, 512), (40, 7)])
def test_agrees_with_comparing_all(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hard, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard, "BLOCK_ROWS", block)
    rows = clustered(1)
    want = expected(rows, lambda i: i % 5 == 0)
    assert got(spark, rows) == want and len(want) > 300


def test_ties_and_small_whole_numbers(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 2), [rng.randint(-1, 1) / 256 for _ in range(3)]) for i in range(120)]
    assert got(spark, rows) == expected(rows, lambda i: i % 5 == 0)


def test_rows_that_take_no_part_and_odd_vectors(spark):
    rows = clustered(2, 60)
    rows += [
        (None, 1, rows[0][2]),
        (1000, None, rows[0][2]),
        (1005, 1, None),
        (1010, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
        (1015, 1, [float("nan")] + [0.0] * 5),
        (1020, 1, [float("inf")] + [0.0] * 5),
        (1025, 1, [1e308] + [0.0] * 5),
    ]
    rows += [(2000 + i, i % 2, [0.5, 0.25 * i]) for i in range(12)] + [(3000 + i, i % 2, []) for i in range(7)]
    rows += [(4000 + i, i % 2, [0.0, 0.0, 0.0]) for i in range(6)]
    rows += [rows[0], rows[0], (7, 2, rows[3][2]), (7, 1, rows[4][2])]
    want = expected(rows, lambda i: i % 5 == 0)
    assert got(spark, rows) == want and {r[0] // 1000 for r in want} == {0, 2, 3, 4}


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [2.0**20 + rng.random(), 2.0**20 + rng.random()]) for i in range(40)]
    rows += [(100 + i, i % 2, [1e6 * (i + 1) + 0.5, 0.0, 1.0, 0.0]) for i in range(10)]
    assert got(spark, rows) == expected(rows, lambda i: i % 5 == 0)
    huge = [(i, i % 2, [1e300, float(i)]) for i in range(10)]
    assert all(r[4] == 2**63 - 1 for r in got(spark, huge))


def test_no_rows(spark):
    assert got(spark, []) == [] and got(spark, [(5, 1, [1.0])]) == []


def test_bounds_spare_scores():
    rows = clustered(4, 600)
    frame = pd.DataFrame({"id": [r[0] for r in rows], "label": [r[1] for r in rows], "vector": [[math.floor(256 * x) for x in r[2]] for r in rows]})
    anchors = frame[:60].copy()
    vectors = np.array(anchors["vector"].tolist(), float)
    order, parent, edge = hard.spanning_tree(vectors)
    place = np.empty(60, int)
    place[order] = np.arange(60)
    assert sorted(order) == list(range(60)) and all(place[p] < place[k] for k, p in enumerate(parent) if p >= 0)
    assert np.allclose(edge[1:], [np.linalg.norm(vectors[k] - vectors[parent[k]]) for k in range(1, 60)])
    anchors = anchors.assign(place=place, parent=np.where(parent < 0, -1, place[parent]), edge=edge)
    walk = hard.Walk(hard.Shard(frame), anchors.sort_values("place", ignore_index=True))
    best = [hard.Best(5) for _ in range(60)]
    walk.run(
        lambda a, at: np.ones(at.stop - at.start, bool),
        lambda a, low: (np.partition(low, -5)[-5], np.inf),
        lambda a, at, s: best[a].add(walk.shard.ids[at], s),
    )
    scores = vectors[order] @ np.array(frame["vector"].tolist(), float).T
    for b, s in zip(best, scores):
        assert b.ids.tolist() == np.lexsort([np.arange(600), -s])[:5].tolist()
    # Most of what other clusters hold is left out.
    assert walk.computed < 0.6 * walk.pairs
