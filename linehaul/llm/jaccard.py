"""Exact Jaccard join of word shingles, with token-combination prefixes.

A document's tokens are the hashes of its word shingles. They are put in one global
order: tokens of rare classes first, then those of frequent ones, by hash within each.
Documents with at least ``percent`` / 100 of their union in common miss at most ``d`` of
their tokens each, so the first token they share lies among the first ``d + 1``. If it
is rare, it alone is an index key. Otherwise all they share is frequent: the prefix is
extended until two neighbouring shared tokens must stand close together in both, and
pairs of frequent tokens up to ``GAP`` apart are the keys (see :func:`_keys`). That is
far fewer rows than all pairs of a long prefix, and no pair of documents is missed.

A token class is a cell of a fixed number of cells. Tasks report the cells whose tokens
they saw more often than by chance, and a class is frequent where the reports add up to
``frequent_from`` documents; this decides the plan only, never the result. Equal
sets are one class and stand for one set, and of keys with equal members one stays. Buckets first link to a pivot, their smallest
set; what that leaves unconnected is then paired bucket by bucket across components.
Parity sketches bound a pair's difference from below, and the pairs they let through are
verified on whole sets. So a group of near copies costs about one pair per copy.

Defined results: null, empty and blank texts have an empty set and link with nothing.
A document with fewer words than a shingle has its words as one shingle. Rows of one id
are one document that links with what any of them does. Rows without an id keep a null
component. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.components import components
from linehaul.llm.hashing import Words, chain, has_bit, utf8
from linehaul.llm.stage import bit_set, keyed, staged

#: What separates words: space and the control characters tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Tokens that may stand between the two of a combination.
GAP = 3
#: Cells of token classes and of the bit sets, as powers of two: 2 MB and 8 MB.
CLASS_BITS, KEY_BITS = 24, 26
#: A class is frequent from so many documents on, as far as tasks report them.
FREQUENT = 8
#: Cells that a task may report by chance, as tokens fall on one cell.
CHANCE = 4096
#: 64-bit words of a parity sketch.
SKETCH = 8

_SETS = "kind int, id bigint, n int, sid bigint, whole binary, sketch array<bigint>, wide binary"


def _reported(tokens: int, frequent_from: int) -> int:
    """The count from which a task reports a cell: at least 2, and so high that hardly more
    than ``CHANCE`` cells get there by chance."""
    if frequent_from < 2:
        return 1
    load = tokens / 2**CLASS_BITS
    least, term, below = 2, load * exp(-load), exp(-load) * (1 + load)
    while 2**CLASS_BITS * (1 - below) > CHANCE:
        term *= load / least
        below += term
        least += 1
    return least


def _sets(n_words: int, frequent_from: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document the size, digest and sketch of its set; at the end of the task the
    cells of frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(BLANKS)
        seen = np.zeros(2**CLASS_BITS, np.uint8)
        total = 0
        for batch in batches:
            tokens = words.shingles(utf8(batch["text"]), n_words)
            digests = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in tokens]
            for t in tokens:
                cells = (t & np.uint64(2**CLASS_BITS - 1)).astype(np.int64)
                seen[cells] = np.minimum(seen[cells], 254) + 1
                total += len(cells)
            yield pa.record_batch(
                {
                    "kind": pa.array(np.zeros(len(tokens), np.int32)),
                    "id": batch["id"],
                    "n": pa.array([len(t) for t in tokens], pa.int32()),
                    "sid": pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                    "whole": pa.array(digests, pa.binary()),
                    "sketch": pa.array([_sketch(t, SKETCH).view(np.int64) for t in tokens], pa.list_(pa.int64())),
                    "wide": pa.array([_sketch(t, _width(len(t))).tobytes() for t in tokens], pa.binary()),
                }
            )
        cells = np.flatnonzero(seen >= _reported(total, frequent_from))
        none = pa.nulls(len(cells))
        yield pa.record_batch(
            {
                "kind": pa.array(np.ones(len(cells), np.int32)),
                "id": pa.array(cells),
                "n": pa.array(seen[cells].astype(np.int32)),
                "sid": none.cast(pa.int64()),
                "whole": none.cast(pa.binary()),
                "sketch": none.cast(pa.list_(pa.int64())),
                "wide": none.cast(pa.binary()),
            }
        )

    return run


def _width(n: int) -> int:
    """64-bit words of a set's wide sketch: a power of two, a bit or more per token."""
    return max(SKETCH, 1 << ((n + 63) // 64 - 1).bit_length() if n else 0)


def _sketch(tokens: np.ndarray, words: int) -> np.ndarray:
    """Bit i is the parity of the tokens that fall on it; two sketches differ in no more
    bits than the sets have tokens that only one of them holds. Halves of a wide sketch
    laid over each other are the sketch of half the width."""
    cell = ((tokens >> np.uint64(32)) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=64 * words) & 1).astype(np.uint8))


def _close(percent: int) -> Callable:
    """Pairs whose sizes and wide sketches leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            columns = (batch[c].to_pylist() for c in ("na", "nb", "wa", "wb"))
            for na, nb, x, y in zip(*columns):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                differ = int(np.bitwise_count(x ^ y).sum())
                sizes = 100 * min(na, nb) >= percent * max(na, nb)
                good.append(sizes and (100 + percent) * differ <= (100 - percent) * (na + nb))
            part = batch.filter(pa.array(good, pa.bool_()))
            yield pa.record_batch({"a": part["a"], "b": part["b"]})

    return run


def _keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of one set.

    ``d`` is the most tokens a linked set can lack. Shared tokens number ``s`` within the
    first ``d + s``; their ``s - 1`` neighbour pairs have at most ``d`` others between them
    here and ``(d + 1) * 100 / percent`` in the partner, so with the ``s`` below some pair
    has at most ``GAP`` others between its tokens on both sides.
    """
    n = len(tokens)
    if n < -(-percent // (100 - percent)):
        return np.zeros(0, np.uint64)  # only an equal set can link
    d = n * (100 - percent) // 100
    s = 2 + -(-(d + 1) * (100 + percent) // (percent * (GAP + 1)))
    hot = has_bit(frequent, tokens, CLASS_BITS)
    rare, often = tokens[~hot], tokens[hot]
    keys = [rare[: d + 1]]
    often = often[: max(0, d + s - len(rare))]
    for gap in range(1, GAP + 2):
        if len(often) > gap:
            keys.append(chain_pairs(often[:-gap], often[gap:]))
    return np.concatenate(keys)


def chain_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.empty(2 * len(a), np.uint64)
    both[::2], both[1::2] = a, b
    return chain(both, 2)[::2]


def _postings(n_words: int, percent: int, frequent, wanted) -> Callable:
    """``(k, sid, id, n)`` of every key, equal sets of a batch once; ``wanted`` is a bit set of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(BLANKS)
        hot = np.frombuffer(frequent.value, np.uint8)
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            texts, ids = utf8(batch["text"]), batch["id"].to_pylist()
            first: dict[bytes, int] = {}
            sets = words.shingles(texts, n_words)
            for i, t in enumerate(sets):
                digest = hashlib.blake2b(t.tobytes(), digest_size=16).digest()
                if ids[i] is not None and (digest not in first or ids[i] < ids[first[digest]]):
                    first[digest] = i
            for digest, i in first.items():
                keys = _keys(sets[i], hot, percent)
                sets[i] = (keys if bits is None else keys[has_bit(bits, keys, KEY_BITS)], digest)
            rows = [(ids[i], len(sets[i][0]), sets[i]) for i in first.values()]
            counts = [c for _, c, _ in rows]
            sid = [int.from_bytes(s[1][:8], "little", signed=True) for _, _, s in rows]
            yield pa.record_batch(
                {
                    "k": pa.array(np.concatenate([np.zeros(0, np.uint64), *[s[0] for _, _, s in rows]]).view(np.int64)),
                    "sid": pa.array(np.repeat(np.array(sid, np.int64), counts)),
                    "id": pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), counts)),
                }
            )

    return run


def _tokens(n_words: int, wanted) -> Callable:
    """``(id, tokens)`` of the documents whose id is in the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(BLANKS)
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            known = batch["id"].is_valid().to_numpy(zero_copy_only=False)
            whole = batch["id"].fill_null(0).to_numpy().view(np.uint64)  # nulls would make it float64
            part = batch.filter(pa.array(known & has_bit(bits, whole, KEY_BITS)))
            sets = words.shingles(utf8(part["text"]), n_words)
            yield pa.record_batch(
                {"id": part["id"], "tokens": pa.array([t.tobytes() for t in sets], pa.binary())}
            )

    return run


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared) > 0)
            part = batch.filter(pa.array(good, pa.bool_()))
            yield pa.record_batch({"a": part["a"], "b": part["b"]})

    return run


def _could_link(percent: int) -> Column:
    """Whether sizes and sketches of ``x`` and ``y`` leave a link possible."""
    x, y = F.col("x"), F.col("y")
    differ = sum(
        (F.bit_count(x["sketch"][i].bitwiseXOR(y["sketch"][i])) for i in range(SKETCH)),
        start=F.lit(0),
    )
    total = x["n"] + y["n"]
    return (
        (100 * x["n"] >= percent * y["n"])
        & (100 * y["n"] >= percent * x["n"])
        & ((100 + percent) * differ <= (100 - percent) * total)
    )


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = 5,
    percent: int = 80,
    frequent_from: int = FREQUENT,
) -> DataFrame:
    """``(id, n, component, linked)`` of every row: its id, the size of its set, the smallest
    id reachable by links of ``percent`` / 100 and whether its set was linked to another.

    ``percent`` is at least 70, as the prefixes rely on it.
    """
    if not 70 <= percent < 100:
        raise ValueError("percent must be from 70 to 99")
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = keyed(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    both = staged(texts.mapInArrow(_sets(n_words, frequent_from), _SETS), "sets")
    sets = both.where("kind = 0")
    classes = staged(
        sets.where("n > 0 and id is not null")
        .groupBy("whole", "sid", "n")
        .agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")),
        "classes",
    )
    reported = both.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    frequent = share(bit_set(reported.where(F.col("n") >= frequent_from), F.col("id"), CLASS_BITS))

    def postings(wanted=None) -> DataFrame:
        return texts.mapInArrow(
            _postings(n_words, percent, frequent, wanted), "k bigint, sid bigint, id bigint"
        )

    # Keys of two or more different sets, with the bucket's pivot.
    several = staged(
        postings()
        .groupBy("k")
        .agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.min("id").alias("pivot"))
        .where("low <> high")
        .select("k", "pivot"),
        "keys",
    )
    wanted = share(bit_set(several, F.col("k"), KEY_BITS))
    shape = F.struct("n", "sketch")
    sizes = classes.select("rep", shape.alias("shape"))
    wide = classes.select("rep", "n", "wide")
    buckets = staged(
        postings(wanted).join(several, "k").groupBy("k", "sid").agg(F.min("id").alias("id"), F.min("pivot").alias("pivot")),
        "buckets",
    )

    # Close sets share many keys. Of keys with the same members one is enough.
    members = buckets.groupBy("k").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"),
    )
    one = members.groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k")
    buckets = staged(buckets.join(one, "k", "left_semi"), "buckets")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs that could link, each once."""
        x = wide.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
        y = wide.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
        once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return once.join(x, "a").join(y, "b").mapInArrow(_close(percent), "a bigint, b bigint")

    def verified(pairs: DataFrame, purpose: str) -> DataFrame:
        pairs = staged(close(pairs).distinct(), "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        few = texts.mapInArrow(
            _tokens(n_words, share(bit_set(ids, F.col("id"), KEY_BITS))), "id bigint, tokens binary"
        ).join(ids, "id", "left_semi")
        few = staged(few, "tokens")
        x = few.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
        y = few.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
        found = pairs.join(x, "a").join(y, "b").mapInArrow(_verify(percent), "a bigint, b bigint")
        return staged(found.distinct(), purpose)

    star = buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = verified(star, "links")
    joined = components(links)

    # Buckets that are not one component yet: members outside the pivot's component meet
    # all members of other components.
    mine = joined.select("id", F.col("component").alias("mine"))
    pivots = joined.select(F.col("id").alias("pivot"), F.col("component").alias("pivots"))
    members = (
        buckets.join(mine, "id", "left")
        .join(pivots, "pivot", "left")
        .withColumn("mine", F.coalesce("mine", "id"))
        .withColumn("pivots", F.coalesce("pivots", "pivot"))
    )
    members = staged(
        members.join(sizes.withColumnRenamed("rep", "id"), "id").select("k", "id", "pivot", "mine", "pivots", "shape"),
        "members",
    )
    out = members.where("mine <> pivots").select(
        "k", F.col("id").alias("a"), F.col("mine").alias("ma"), F.col("pivot"), F.col("shape").alias("x")
    )
    all_ = members.select("k", F.col("id").alias("b"), F.col("mine").alias("mb"), F.col("shape").alias("y"))
    across = out.join(all_, "k").where((F.col("ma") != F.col("mb")) & (F.col("b") != F.col("pivot")) & _could_link(percent))
    more = verified(across.select("a", "b"), "links2")

    # One id in several classes ties them together.
    own = sets.join(classes.select("whole", "rep"), "whole").where("id is not null")
    tied = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a <> high")
    ties = own.join(tied.select("id", "a"), "id").where("a <> rep").select("a", F.col("rep").alias("b"))
    every = staged(links.union(more).union(ties), "all_links")
    labels = components(every).withColumnRenamed("id", "rep")
    by_set = classes.join(labels, "rep", "left").select(
        "whole", F.coalesce("component", "rep").alias("component"), F.col("component").isNotNull().alias("linked")
    )
    out = sets.join(by_set, "whole", "left")
    return out.select(
        "id",
        F.col("n").cast("long").alias("n"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"),
        F.coalesce("linked", F.lit(False)).alias("linked"),
    )


def component_report(
    docs: DataFrame, n_words: int = 3, percent: int = 90, frequent_from: int = FREQUENT
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    out = jaccard_components(docs, "doc_id", "text", n_words, percent, frequent_from)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
