"""Benchmark passages in training documents, by suffix arrays of the documents.

Documents are cut into word hashes; each batch of documents is a shard with a sorted
suffix array of its word positions. A position whose first words no test item has cannot
begin a match and is left out of the array; which those are comes from a set of the
items' leading word groups. Every suffix of every test item is searched in every shard,
one word deeper at a time by binary search for all suffixes at once, which gives its
longest verbatim match up to the window and the range of places that have it. Longer
matches are runs of windows on one diagonal. All words inside a matched window are hit.

Test items are a query set that stands against all documents. They are taken in blocks
of at most ``BLOCK_BYTES`` of text, one after the other, so what a task or the driver holds does not grow with
them; what a block finds is written down and put together per document with what the next one finds.

Defined results: null texts and texts without words have no hits; null items, or items
without words, have no windows. An item that occurs twice counts once by its id. Repeated
rows are judged alike. A very long text is a shard of its own. Extra columns are not read, or kept by :func:`clean_documents`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linehaul.llm.hashing import Words, chain, utf8
from linehaul.llm.stage import small_batches, staged

#: Bytes that end a word: ASCII but digits and letters.
NO_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Bytes of test text in one block.
BLOCK_BYTES = 8 << 20
#: Leading words by which places are picked for the suffix array.
LEAD = 3
#: Bytes of documents in one shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20


class Items:
    """A block of test items: their windows as suffixes of word hashes."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        h, number, place = Words(NO_WORD).cut(texts)
        size = np.bincount(number, minlength=len(texts))
        self.depth = np.minimum(size, window)[number]  # words of a window of the item
        begins = np.flatnonzero(place + self.depth <= size[number])
        self.depth, self.item = self.depth[begins], number[begins]
        self.place = place[begins]
        padded = np.concatenate([h, np.zeros(window, np.uint64)])
        self.words = np.stack([padded[begins + k] for k in range(window)]) if len(begins) else np.zeros((window, 0), np.uint64)
        self.names = ids
        self.leads = {}
        for k in range(1, LEAD + 1):
            mine = begins[self.depth == k] if k < LEAD else begins[self.depth >= k]
            if len(mine):
                self.leads[k] = np.unique(chain_at(padded, mine, k))


def chain_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on."""
    rows = np.stack([h[at + k] for k in range(n)], 1).ravel()
    return chain(rows, n)[::n]


def suffix_array(h: np.ndarray, left: np.ndarray, leads: dict[int, np.ndarray], window: int) -> np.ndarray:
    """Places in the order of the words from there on, to a depth of ``window`` words.

    ``left`` tells how many words the text has from a place on; past its end a suffix is
    shorter, which sorts it first (its words read as zero).
    """
    picked = np.zeros(len(h), bool)
    for n, known in leads.items():
        groups = chain(h, n)
        at = np.clip(np.searchsorted(known, groups), 0, len(known) - 1)
        picked[: len(groups)] |= known[at] == groups
    places = np.flatnonzero(picked)
    return places[np.lexsort([word_at(h, left, places, k) for k in reversed(range(window))])]


def word_at(h: np.ndarray, left: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    inside = left[places] > k
    return np.where(inside, h[np.where(inside, places + k, 0)], np.uint64(0))


def search(h: np.ndarray, left: np.ndarray, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range of the suffix array for every test suffix at its longest match, and its length."""
    n = len(items.item)
    low, high, matched = np.zeros(n, np.int64), np.full(n, len(array)), np.zeros(n, np.int64)
    live = np.arange(n)
    for k in range(len(items.words)):
        live = live[items.depth[live] > k]
        if not len(live):
            break
        column, want = word_at(h, left, array, k), items.words[k][live]
        a = _bound(column, want, low[live], high[live], False)
        b = _bound(column, want, low[live], high[live], True)
        found = a < b
        live = live[found]
        low[live], high[live], matched[live] = a[found], b[found], k + 1
    return low, high, matched


def _bound(column: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value within its own range."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        value = column[np.where(open_, middle, 0)] if len(column) else want
        less = open_ & ((value <= want) if right else (value < want))
        low[less] = middle[less] + 1
        rest = open_ & ~less
        high[rest] = middle[rest]
    return low


def hits_of(texts: list[bytes], words: Words, items: Items, window: int) -> list[tuple[int, list, list[str], int]]:
    """Words, merged hit spans (in words), items and the longest match of each text."""
    h, number, place = words.cut(texts)
    size = np.bincount(number, minlength=len(texts))
    left = size[number] - place
    array = suffix_array(h, left, items.leads, window)
    low, high, matched = search(h, left, array, items)
    whole = np.flatnonzero((matched == items.depth) & (high > low))
    count = (high - low)[whole]
    suffix = np.repeat(whole, count)
    inside = np.arange(len(suffix)) - np.repeat(np.cumsum(count) - count, count)
    at = array[np.repeat(low[whole], count) + inside]
    spans: list[list] = [[] for _ in texts]
    order = np.argsort(at, kind="stable")
    for t, start, end in zip(
        number[at[order]].tolist(), place[at[order]].tolist(), (place[at] + items.depth[suffix])[order].tolist()
    ):
        mine = spans[t]
        if mine and start <= mine[-1]["end"]:
            mine[-1]["end"] = max(end, mine[-1]["end"])
        else:
            mine.append({"start": start, "end": end})
    found: list[set[str]] = [set() for _ in texts]
    for t, i in set(zip(number[at].tolist(), items.item[suffix].tolist())):
        if items.names[i] is not None:
            found[t].add(items.names[i])
    longest = np.zeros(len(texts), np.int64)
    if len(at):
        order = np.lexsort([at, at - items.place[suffix], items.item[suffix]])
        p, s = at[order], suffix[order]
        new = np.ones(len(p), bool)
        same = (items.item[s][1:] == items.item[s][:-1]) & (p[1:] - p[:-1] == 1)
        new[1:] = ~(same & (items.place[s][1:] - items.place[s][:-1] == 1))
        run = np.cumsum(new) - 1
        np.maximum.at(longest, number[p], np.bincount(run)[run] - 1 + items.depth[s])
    return [(int(size[t]), spans[t], sorted(found[t]), int(longest[t])) for t in range(len(texts))]


_FOUND = {
    "n_words": pa.int64(),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    "items": pa.list_(pa.string()),
    "longest": pa.int64(),
}
_FOUND_SQL = (
    "n_words bigint, spans array<struct<start: bigint, end: bigint>>, "
    "items array<string>, longest bigint"
)


def _judge(shared, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what one block of items finds to what earlier blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(NO_WORD)
        items = Items(*shared.value, window)
        for shard in _shards(batches):
            rows = hits_of(utf8(shard["text"]), words, items, window)
            if shard["n_words"].null_count < len(rows):
                rows = [_both(r, o) for r, o in zip(rows, shard.select(list(_FOUND)).to_pylist())]
            out = {"row": shard["row"], "text": shard["text"]}
            for column, (name, kind) in enumerate(_FOUND.items()):
                out[name] = pa.array([r[column] for r in rows], kind)
            yield pa.record_batch(out)

    return run


def _both(new: tuple, old: dict) -> tuple:
    spans: list[dict] = []
    for x in sorted(new[1] + old["spans"], key=lambda x: (x["start"], x["end"])):
        if spans and x["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(x["end"], spans[-1]["end"])
        else:
            spans.append(dict(x))
    return new[0], spans, sorted({*new[2], *old["items"]}), max(new[3], old["longest"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``SHARD_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _blocks(tests: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of the test items, block by block."""
    ids, texts, size = [], [], 0
    rows = tests.select(tests[id_col].cast("string"), tests[text_col].cast("binary"))
    for r in rows.toLocalIterator():
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(bytes(r[1] or b""))
        size += len(texts[-1])
    yield ids, texts


def benchmark_hits(
    docs: DataFrame,
    tests: DataFrame,
    keep: list[str],
    text_col: str = "text",
    test_id: str = "item_id",
    test_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """One row a document: ``row`` (a struct of the kept columns), ``n_words``, hit ``spans``
    (word numbers, end exclusive, merged), ``items`` (ids as sorted strings) and ``longest``
    (words of the longest verbatim match that has a whole window, else 0)."""
    small_batches(docs.sparkSession)
    row = F.struct(*[docs[c] for c in keep]).alias("row")
    out = docs.select(row, docs[text_col].alias("text")).withColumns(
        {
            "n_words": F.lit(None).cast("bigint"),
            "spans": F.lit(None).cast("array<struct<start: bigint, end: bigint>>"),
            "items": F.lit(None).cast("array<string>"),
            "longest": F.lit(None).cast("bigint"),
        }
    )
    kind = out.select("row").schema["row"].dataType.simpleString()
    shared = None
    for block in _blocks(tests, test_id, test_text):
        if shared is not None:
            # What earlier blocks found is written down, so that one block at a time is held by tasks and driver.
            out = staged(out, "hits_so_far")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_judge(shared, window), f"row {kind}, text string, {_FOUND_SQL}")
    return out.drop("text")


def clean_documents(docs: DataFrame, tests: DataFrame, **how) -> DataFrame:
    """The documents without any hit, with their columns as they were."""
    return benchmark_hits(docs, tests, docs.columns, **how).where("size(spans) = 0").select("row.*")


def contamination_report(docs: DataFrame, tests: DataFrame, window: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest)`` of every document."""
    out = benchmark_hits(docs, tests, ["doc_id"], window=window)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return out.select(
        "row.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        "longest",
    )
