"""Best-fit packing by bin completion: whole documents in as few sequences as found.

How pieces share sequences depends on their lengths alone, and a length lies between 1 and
``capacity``. So the search sees counts of lengths, whose number is bounded however many
pieces there are, and its result is a bounded list of fillings with how often each is used.
The pieces themselves never move for it: each task numbers its pieces of every length,
prefix sums over the tasks make that a number in the corpus, and the number says which use
of which filling the piece goes to.

The search takes the largest length left, enumerates the undominated ways to fill the rest of its
sequence (no piece or pair in them could give way to a larger piece that is left), and
branches on them, least waste first; a filling is used as often as its pieces last, or
once. A branch ends where its waste and a bound on the waste of what is left exceed
what the best packing so far allows. Best fit in decreasing order is the first such packing,
so the result is never worse. The search stops at the lower bound, or after ``NODES``
branches; the packing is whole either way.

Defined results: null and empty texts are the end id alone. Longer texts than the capacity are
cut, into full pieces and a rest. Repeated rows and null ids are documents like others. An empty
table has no pieces. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linehaul.llm.hashing import utf8
from linehaul.llm.packing import WIDTH, word_ids
from linehaul.llm.stage import keyed, staged

#: Branches of the search; fillings looked at and kept at one branch.
NODES, LOOKED, KEPT = 10_000, 256, 16
#: Tasks of one block of prefix sums.
BLOCK = 1024

#: A filling: lengths and how often each is in it.
Filling = tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences any packing needs, from ``counts`` by length (0 to capacity).

    All tokens have to fit; and for each least length k, pieces above capacity - k stand alone,
    the others above a half can't share, and pieces from k to a half need room beside those.
    """
    many, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(1, half + 1)
    alone, apart = many[-1] - many[capacity - k], many[capacity - k] - many[half]
    room = apart * capacity - (tokens[capacity - k] - tokens[half])
    rest = np.maximum(tokens[half] - tokens[k - 1] - room, 0)
    return int(max(-(-tokens[-1] // capacity), (alone + apart - (-rest // capacity)).max(initial=0)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit in decreasing order, sequences of one content at a time."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Filling, int]]] = {}

    def put(room: int, filling: Filling, n: int) -> None:
        if n and room not in groups:
            rooms.insert(bisect_left(rooms, room), room)
            groups[room] = []
        if n:
            groups[room].append((filling, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                room, filling, n = capacity, (), -(-left // (capacity // size))
            else:
                room = rooms[k]
                filling, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            each = room // size
            full = min(n, left // each)
            part = left % each if full < n and full == left // each else 0
            put(room - each * size, (*filling, (size, each)), full)
            put(room - part * size, (*filling, (size, part)), 1 if part else 0)
            put(room, filling, n - full - (1 if part else 0))
            left -= full * each + part
    return [(f, n) for g in groups.values() for f, n in g]


def fillings(counts: list[int], sizes: list[int], room: int) -> list[tuple[int, Filling]]:
    """Undominated ways to fill a room with pieces that are left, with their waste, least first.

    ``sizes`` are the lengths left in rising order, ``counts`` goes by length. The first way
    without waste ends the enumeration.
    """
    found: dict[Filling, int] = {}
    chosen: list[tuple[int, int]] = []
    looked = 0

    def left_between(low: int, high: int) -> bool:
        return any(counts[sizes[k]] > 0 for k in range(bisect_left(sizes, low), bisect_right(sizes, high)))

    def dominated(waste: int) -> bool:
        """Whether a larger piece that is left fits in place of a chosen one, or one piece in place of two."""
        sums = {a + b for k, (a, n) in enumerate(chosen) for b, _ in chosen[k if n > 1 else k + 1 :]}
        return any(left_between(a + 1, a + waste) for a, _ in chosen) or any(left_between(s, s + waste) for s in sums)

    def fill(top: int, room: int) -> bool:
        """Whether the enumeration is over."""
        nonlocal looked
        leaf = True
        for k in range(min(top, bisect_right(sizes, room) - 1), -1, -1):
            size = sizes[k]
            for times in range(min(counts[size], room // size), 0, -1):
                leaf = False
                counts[size] -= times
                chosen.append((size, times))
                over = fill(k - 1, room - times * size)
                chosen.pop()
                counts[size] += times
                if over:
                    return True
        if not leaf:
            return False
        looked += 1
        if room == 0 or not dominated(room):
            found[tuple(chosen)] = room
        return room == 0 or looked >= LOOKED

    fill(len(sizes) - 1, room)
    return sorted(((w, f) for f, w in found.items()), key=lambda x: x[0])[:KEPT]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, for all pieces of these lengths."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    left = [counts.get(s, 0) for s in range(capacity + 1)]
    least = lower_bound(np.array(left), capacity)
    tokens = sum(s * n for s, n in counts.items())
    taken: list[tuple[Filling, int, int]] = []
    done = waste = nodes = 0

    def options(sizes: list[int]) -> Iterator[tuple[Filling, int, int]]:
        top = sizes[-1]
        left[top] -= 1
        ways = fillings(left, sizes, capacity - top)
        left[top] += 1
        for lost, others in ways:
            uses = dict(others)
            uses[top] = uses.get(top, 0) + 1
            most = min(left[s] // k for s, k in uses.items())
            yield tuple(uses.items()), most, lost
            if most > 1:
                yield tuple(uses.items()), 1, lost

    def take(filling: Filling, times: int) -> None:
        for s, k in filling:
            left[s] -= k * times

    stack = [options(sorted(counts))] if counts else []
    while stack and used > least and nodes < NODES:
        option = next(stack[-1], None)
        if option is None:
            stack.pop()
            if taken:
                filling, times, lost = taken.pop()
                take(filling, -times)
                waste -= times * lost
                done -= times
            continue
        filling, times, lost = option
        if lost:
            times = min(times, ((used - 1) * capacity - tokens - waste) // lost)
        if times < 1:
            continue
        nodes += 1
        take(filling, times)
        rest = np.array(left)
        if done + times + lower_bound(rest, capacity) >= used:
            take(filling, -times)
            continue
        sizes = np.flatnonzero(rest).tolist()
        if sizes:
            taken.append((filling, times, lost))
            waste += times * lost
            done += times
            stack.append(options(sizes))
        else:
            best = [(f, n) for f, n, _ in taken] + [(filling, times)]
            used = done + times
            take(filling, -times)
    return best


def _tokenized(tokenizer_file: str, end: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_file)
        task = TaskContext.get().partitionId()
        last = end.to_bytes(WIDTH, "little")
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids = [i + last for i in ids_of.many(utf8(batch["text"]))]
            sizes = [len(i) // WIDTH for i in ids]
            full_at, rest_at = [], []
            for n in sizes:
                full, rest = divmod(n, capacity)
                full_at.append(seen[capacity])
                rest_at.append(seen[rest])
                seen[capacity] += full
                seen[rest] += 1
            columns = {
                "id": batch["id"],
                "task": pa.array([task] * len(ids), pa.int64()),
                "n": pa.array(sizes, pa.int64()),
                "full_at": pa.array(full_at, pa.int64()),
                "rest_at": pa.array(rest_at, pa.int64()),
                "ids": pa.array(ids, pa.binary()),
            }
            yield pa.record_batch(columns)

    return run


def _bases(tokens: DataFrame, capacity: int) -> DataFrame:
    """``(task, length, c, base)``: pieces of a length in a task, and in the tasks before it."""
    lengths = F.array(
        F.struct(F.lit(capacity).cast("long").alias("length"), F.expr(f"n div {capacity}").alias("c")),
        F.struct((F.col("n") % capacity).alias("length"), F.lit(1).cast("long").alias("c")),
    )
    every = tokens.select("task", F.inline(lengths)).where("length > 0 and c > 0")
    totals = every.groupBy("task", "length").agg(F.sum("c").alias("c")).withColumn("block", F.expr(f"task div {BLOCK}"))
    blocks = totals.groupBy("length", "block").agg(F.sum("c").alias("c"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("block_base"))
    inside = Window.partitionBy("length", "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("c").over(inside), F.lit(0)) + F.col("block_base")
    return totals.join(blocks, ["length", "block"]).select("task", "length", "c", base.alias("base"))


def _places(plan: list[tuple[Filling, int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Per length, its uses in order: number of its first piece, first sequence, pieces a sequence, place there."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    at: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        place = 0
        for size, uses in filling:
            runs.setdefault(size, []).append((at.get(size, 0), sequence, uses, place))
            at[size] = at.get(size, 0) + times * uses
            place += size * uses
        sequence += times
    return sorted(runs.items())


def pack_whole(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end: int = 0,
) -> DataFrame:
    """One row a piece: ``id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit), ``sequence`` and ``offset`` in it."""
    spark = docs.sparkSession
    texts = keyed(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    schema = "id bigint, task bigint, n bigint, full_at bigint, rest_at bigint, ids binary"
    tokens = staged(texts.mapInArrow(_tokenized(tokenizer_file, end, capacity), schema), "tokens", "zstd")
    bases = staged(_bases(tokens, capacity), "bases")
    # At most `capacity` rows, however large the table.
    counts = {r["length"]: r["c"] for r in bases.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    runs = spark.createDataFrame(
        _places(pack_lengths(counts, capacity)),
        "length bigint, runs array<struct<start: bigint, first: bigint, uses: bigint, place: bigint>>",
    )
    pieces = tokens.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((n - 1) div {capacity} as int))")))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.withColumn("start", start).withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("start")))
    pieces = pieces.withColumn("rank", F.when(F.col("length") == capacity, F.col("full_at") + F.col("piece")).otherwise(F.col("rest_at")))
    cut = pieces.select(
        "id",
        "piece",
        "start",
        "length",
        F.expr(f"substring(ids, cast(start * {WIDTH} + 1 as int), cast(length * {WIDTH} as int))").alias("ids"),
        "task",
        "rank",
    )
    # A row per task and length: broadcast below the session's threshold, shuffled beyond.
    placed = cut.join(bases.select("task", "length", "base"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    # Bounded: a row per length, and no more runs than the search has fillings.
    placed = placed.join(F.broadcast(runs), "length")
    run = F.element_at(F.filter("runs", lambda r: r["start"] <= F.col("rank")), -1)
    placed = placed.withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.start"))
    return placed.select(
        "id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("run.first") + F.expr("nth div run.uses")).alias("sequence"),
        (F.col("run.place") + F.col("nth") % F.col("run.uses") * F.col("length")).alias("offset"),
    )


def piece_report(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack_whole(docs, tokenizer_file).select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"),
        "offset",
    )
