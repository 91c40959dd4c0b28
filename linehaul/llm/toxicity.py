"""Toxicity of whole texts: a linear classifier on character n-grams scaled by naive Bayes.

A text's features are the distinct n-grams of its lower-cased UTF-8 bytes, hashed into
``2 ** BITS`` cells. From labelled texts every cell gets the log ratio of its smoothed
document frequencies in the two classes; all cells that tell the classes apart by ``LEAST_Z``
standard errors or more stay. A logistic regression with ridge penalty is fitted on presence
times ratio by Newton steps, and its intercept moved from the sample's class balance to that
of all labels. Scoring is a lookup per n-gram in one table of fixed size, map-only.

The fit sees at most ``sample_rows`` labelled ids of each class, chosen by a hash, and of
rows that share such an id the smallest text; the class balance counts all labels. That
bounds the sample's rows (texts are whole), and the number of cells bounds the model.

Defined results: a null or empty text has no features and scores as the intercept says.
Labels that are null or that contradict another label of the same id are not learned
from. Without labels of both classes every score is the share of label 1, or 0 without
any label. Extra columns are not read, or kept by :func:`drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.hashing import BLOCK

BITS = 20
ORDERS = (4, 5, 6)
LEAST_Z = 3.0
#: Labelled ids of each class that the fit sees at most, a row each.
SAMPLE_ROWS = 8000
#: Documents' worth of prior in each cell's ratio, and the ridge penalty.
PRIOR, RIDGE = 10.0, 0.5
#: The fit ends where the gradient is this share of the first, or after so many Newton steps,
#: each of at most so many conjugate gradient steps.
CLOSE, STEPS, INNER = 1e-6, 50, 200
#: Rows that the fit multiplies at once.
FIT_ROWS = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def cells(text: str, keep: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct cells of the text's n-grams; of those in the mask, if there is one."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace")
    values = _FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint64) + np.uint64(1)
    found = [np.zeros(0, np.int32)]
    for at in range(0, len(values), BLOCK):
        v = values[at : at + BLOCK + ORDERS[-1] - 1]
        h = np.zeros(len(v), np.uint64)
        for n in range(1, ORDERS[-1] + 1):
            h = h[: len(v) - n + 1] * _BASE + v[n - 1 :]
            if n in ORDERS and len(h):
                cell = (((h ^ (h >> np.uint64(29))) * _BASE) >> np.uint64(64 - BITS)).astype(np.int32)
                found.append(cell if keep is None else cell[keep[cell]])
    return np.unique(np.concatenate(found))


def fit(texts: list[str], labels: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Cells, weights and intercept from a sample; ``share`` is that of label 1 in all labels."""
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    texts, labels = [texts[i] for i in order], labels[order]
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(share / (1 - share)))
    count = np.zeros((2, 2**BITS))
    for t, y in zip(texts, labels):
        count[y, cells(t)] += 1
    n, pooled = n1 + n0, count.sum(0)
    p = (pooled + 0.5) / (n + 1)
    z = np.abs(count[1] / n1 - count[0] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    ratio = np.log((count[1] + PRIOR * n1 / n) / n1 / ((count[0] + PRIOR * n0 / n) / n0))
    z[pooled < 2] = 0
    keep = z >= LEAST_Z
    chosen = np.flatnonzero(keep)
    number = np.zeros(2**BITS, np.int32)
    number[chosen] = np.arange(len(chosen))
    lists = [np.append(number[cells(t, keep)], np.int32(len(chosen))) for t in texts]
    weight, bias = _ridge(lists, ratio[chosen], labels)
    bias += np.log(share / (1 - share)) - np.log(n1 / n0)
    return chosen.astype(np.int32), (weight * ratio[chosen]).astype(np.float32), float(bias)


def _ridge(lists: list[np.ndarray], scale: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with ridge penalty; ``lists`` has the
    columns of every row and, as the last, the intercept's."""
    blocks = []
    for i in range(0, len(lists), FIT_ROWS):
        lengths = np.array([len(x) for x in lists[i : i + FIT_ROWS]])
        blocks.append((i, np.concatenate(lists[i : i + FIT_ROWS]), np.cumsum(lengths) - lengths, lengths))
    scale, penalty = np.append(scale, 1.0), np.append(np.full(len(scale), RIDGE), 0.0)

    def rows(w: np.ndarray) -> np.ndarray:
        w = w * scale
        return np.concatenate([np.add.reduceat(w[column], start) for _, column, start, _ in blocks])

    def columns(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(scale))
        for i, column, _, lengths in blocks:
            out += np.bincount(column, np.repeat(v[i : i + len(lengths)], lengths), len(scale))
        return out

    def loss(margin: np.ndarray, w: np.ndarray) -> float:
        return float((np.logaddexp(0, margin) - labels * margin).sum() + (penalty * w * w).sum() / 2)

    w, first = np.zeros(len(scale)), 0.0
    margin = rows(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        gradient = columns(p - labels) * scale + penalty * w
        size = float(np.linalg.norm(gradient))
        first = first or size
        if size <= CLOSE * first:
            break
        curve = p * (1 - p)
        # Conjugate gradients for the Newton step, scaled by the diagonal.
        diagonal = columns(curve) * scale**2 + penalty
        step, left = np.zeros(len(w)), -gradient
        along = scaled = left / diagonal
        dot = float(left @ scaled)
        for _ in range(INNER):
            bent = columns(curve * rows(along)) * scale + penalty * along
            by = dot / float(along @ bent)
            step, left = step + by * along, left - by * bent
            if np.linalg.norm(left) <= min(0.1, (size / first) ** 0.5) * size:
                break
            scaled = left / diagonal
            dot, before = float(left @ scaled), dot
            along = scaled + dot / before * along
        ahead, slope, now, by = rows(step), float(gradient @ step), loss(margin, w), 1.0
        while by > 1e-6 and loss(margin + by * ahead, w + by * step) > now + 1e-4 * by * slope:
            by /= 2
        if by <= 1e-6:
            break  # as close as rounding allows
        w, margin = w + by * step, margin + by * ahead
    return w[:-1], float(w[-1])


def _fitted(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += [t or "" for t in batch["text"].to_pylist()]
            labels += batch["label"].to_pylist()
        chosen, weights, bias = fit(texts, np.array(labels, np.int64), share)
        yield pa.record_batch(
            {
                "cells": pa.array([chosen.tobytes()], pa.binary()),
                "weights": pa.array([weights.tobytes()], pa.binary()),
                "bias": pa.array([bias], pa.float64()),
            }
        )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    learn: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> tuple[bytes, bytes, float]:
    """A model from the labelled documents; ``learn`` (of the id column ``id``) tells which
    labels may be used."""
    one = (
        labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .where(F.lit(True) if learn is None else learn)
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .where("label = high")
        .select("id", "label")
    )
    sizes = dict(one.groupBy("label").count().collect())
    total = sizes.get(0, 0) + sizes.get(1, 0)
    share = sizes.get(1, 0) / total if total else 0.0
    picks = [
        one.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for y in (0, 1)
    ]
    # Two bounded samples, so the broadcast has at most twice sample_rows rows of 12 bytes.
    sample = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(
        F.broadcast(picks[0].union(picks[1])), "id"
    )
    sample = sample.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    model = (
        sample.select("text", "label")
        .repartition(1)
        .mapInArrow(_fitted(share), "cells binary, weights binary, bias double")
        .first()
    )
    if model is None:  # no labelled text at all
        chosen, weights, bias = fit([], np.zeros(0, np.int64), share)
        return chosen.tobytes(), weights.tobytes(), bias
    return bytes(model[0]), bytes(model[1]), model[2]


def _scored(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, bias = shared.value
        table, keep = np.zeros(2**BITS, np.float32), np.zeros(2**BITS, bool)
        chosen = np.frombuffer(chosen, np.int32)
        table[chosen], keep[chosen] = np.frombuffer(weights, np.float32), True
        for batch in batches:
            margins = [
                float(table[cells(t or "", keep)].sum(dtype=np.float64)) + bias
                for t in batch["text"].to_pylist()
            ]
            scores = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
            yield pa.record_batch({"row": batch["row"], "score": pa.array(scores, pa.float64())})

    return run


def score(docs: DataFrame, model: tuple, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the kept columns) and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scored(shared), f"row {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The documents that score below the threshold, with their columns as they were."""
    model = train(docs, labels, **how)
    text_col = how.get("text_col", "text")
    return score(docs, model, docs.columns, text_col).where(F.col("score") < threshold).select("row.*")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; a quarter of the ids, by checksum, is not learned from."""
    quarter = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2
    model = train(docs, labels, learn=~quarter(F.col("id")))
    out = score(docs, model, ["doc_id"])
    return out.select(
        "row.doc_id",
        quarter(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
