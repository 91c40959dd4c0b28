from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linehaul.llm import bin_completion as bins
from linehaul.llm import queries
from linehaul.llm.stage import small_batches

SF = "/root/testdata/sf0.001"


def least_bins(items: list[int], capacity: int) -> int:
    """By trying all."""
    items, best = sorted(items, reverse=True), len(items)

    def go(k: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for room in set(r for r in rooms if r >= items[k]):
            j = rooms.index(room)
            rooms[j] -= items[k]
            go(k + 1, rooms)
            rooms[j] += items[k]
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def used(plan, counts: Counter, capacity: int) -> int:
    got: Counter = Counter()
    for filling, times in plan:
        assert times > 0 and sum(s * k for s, k in filling) <= capacity
        for s, k in filling:
            got[s] += k * times
    assert got == counts
    return sum(n for _, n in plan)


@pytest.mark.parametrize("seed", range(4))
def test_few_pieces_take_the_fewest_sequences(seed):
    rng = random.Random(seed)
    for trial in range(40):
        capacity = rng.choice([20, 50, 100])
        low, high = (1, capacity) if trial % 2 else (capacity // 5, capacity // 2 + 2)
        items = [rng.randint(low, high) for _ in range(rng.randint(1, 10))]
        counts = Counter(items)
        best = least_bins(items, capacity)
        array = np.array([counts.get(s, 0) for s in range(capacity + 1)])
        assert bins.lower_bound(array, capacity) <= best
        assert used(bins.pack_lengths(counts, capacity), counts, capacity) == best
        assert used(bins.best_fit(counts, capacity), counts, capacity) >= best


def test_search_beats_best_fit():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(600, 760, 3000).tolist())
    found, first = used(bins.pack_lengths(counts, 2048), counts, 2048), used(bins.best_fit(counts, 2048), counts, 2048)
    assert found <= 1.01 * 1000 and first >= 1.05 * 1000


def test_many_of_few_lengths():
    for counts in [Counter({1: 10**9}), Counter({2048: 5}), Counter({1: 5000, 2000: 3, 1500: 2}), Counter({1025: 10**6, 1023: 10**6 - 1}), Counter()]:
        plan = bins.pack_lengths(counts, 2048)
        assert used(plan, counts, 2048) == -(-sum(s * n for s, n in counts.items()) // 2048)
        assert len(plan) <= 8


def test_undominated_fillings():
    counts = [0] * 101
    for s in (10, 20, 30, 55):
        counts[s] = 1
    # 55 takes the place of every filling that fits below it; 10 still fits beside.
    assert bins.fillings(counts, [10, 20, 30, 55], 66) == [(1, ((55, 1), (10, 1)))]
    assert bins.fillings(counts, [10, 20, 30, 55], 9) == [(9, ())]


def test_round_trip(spark):
    from tokenizers import Tokenizer

    rows = queries.op12_best_fit_packing(spark, SF).collect()
    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in documents}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r.start == 2048 * r.piece
        pieces[r.doc_id].append((r.piece, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, of in pieces.items():
        assert [k for k, _ in sorted(of)] == list(range(len(of))) and sum(n for _, n in of) == len(ids[i])
        assert all(n == 2048 for _, n in sorted(of)[:-1])
    for of in sequences.values():
        of.sort()
        assert of[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(of, of[1:])) and sum(of[-1]) <= 2048
    assert pieces.keys() == ids.keys() and len(sequences) == -(-sum(map(len, ids.values())) // 2048)


def test_cases(spark):
    small_batches(spark)
    texts = [(1, None), (1, None), (2, ""), (None, "one two three"), (3, "word " * 10_000)]
    schema = "doc_id long, text string, task int, n int, ids string, length int, rank int, sequence string"
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, "y") for i, t in texts], schema)
    rows = bins.pack_whole(docs.repartition(3), queries.word_tokenizer(), capacity=64).collect()
    tokens = Counter()
    sequences = defaultdict(list)
    for r in rows:
        tokens[r.id] += r.length
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence].append((r.offset, r.length))
    assert tokens == {1: 2, 2: 1, None: 4, 3: 10_001}
    assert sorted(sum(n for _, n in s) for s in sequences.values())[1:] == [64] * (len(sequences) - 1)
    assert bins.pack_whole(docs.limit(0), queries.word_tokenizer()).count() == 0
