"""Repeated byte strings across documents, found by suffix arrays of candidate passages.

A document's *windows* are its strings of ``LENGTH`` bytes. A window is removed when it
also starts earlier: in a document of smaller id, or further left in its own. All windows
are covered, in three steps that each pass on only what the next must look at:

1. Every window has an *anchor*: the least of the hashes of its substrings of ``GRAM`` bytes.
   Neighbouring windows with one anchor are a *segment*; runs of segments up to an anchor
   with low bits zero are a *chunk*. Both depend on nothing but the bytes around, so equal
   windows lie in equal segments' anchors wherever they stand. A chunk that occurred earlier
   is covered whole.
2. An anchor within one chunk text only has nothing left to find. Segments of other
   anchors are gathered by anchor; equal segments stand for their first place, and the
   others are covered whole.
3. Segments of a shard of anchors that still differ are trimmed to the stretches whose
   windows' hashes recur in the shard, equal ones again standing for their first place. What
   overlaps without being equal is suffix-sorted together, linearly, by :func:`suffix_array`. Neighbours in that order that agree on ``LENGTH`` bytes are equal
   windows; all but the first place are covered.

A frequent anchor with many different segments would be one large group; its segments are
cut into their single windows, which are grouped by their own hash instead.

Defined results: null is empty. Rows of one id are passages of one document, and equal
places in them are not earlier than each other. A null id counts as after all others.
Texts shorter than a window keep everything. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.hashing import has_bit, mix, utf8
from linehaul.llm.stage import bit_set, discard, staged

LENGTH, GRAM = 100, 32
#: A chunk ends at one anchor in so many.
CHUNK = 8

#: Cells of the bit set of anchors, as a power of two: 8 MB.
ANCHOR_BITS = 26
#: Cells of the bit set of documents with spans: 8 MB.
DOC_BITS = 26
#: Bytes of texts looked at together, and windows hashed at once (arrays that fit a core's cache).
BLOCK, PART = 1 << 20, 1 << 17
#: Bytes of segments that are sorted together, about, and different segments of one anchor
#: from which they are cut into windows.
SHARD_BYTES, HOT = 1 << 18, 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_VALUES = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = np.uint64(2**22 - 1)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes."""
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * up[: len(raw)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(raw) - size + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def segments(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text with a window: its number and, of its segments, the first window, the
    window after the last and the anchor's hash."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        if size >= LENGTH:
            yield from _segments(texts[at:end], at)
        at = end


def _segments(texts: list[bytes], number: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    begin = np.cumsum([0] + [len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    first, anchor = _runs(raw)
    last = len(raw) - LENGTH + 1
    for i, t in enumerate(texts):
        if len(t) >= LENGTH:
            a, b = int(begin[i]), min(int(begin[i + 1]) - LENGTH + 1, last)
            x, y = np.searchsorted(first, (a, b), "left")
            x = x - 1 if x == len(first) or first[x] > a else x
            start = np.maximum(first[x:y], a) - a
            yield number + i, start, np.append(start[1:], b - a), anchor[x:y]


def _runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchor changes from window to window, and its hash."""
    firsts, anchors = [], []
    windows = len(raw) - LENGTH + 1
    for base in range(0, windows, PART):
        part = raw[base : min(base + PART, windows) + LENGTH - 1]
        h = gram_hashes(part, GRAM)
        place = np.arange(len(h), dtype=np.uint64)
        chosen = (sliding_least((h & ~_PLACE) | place, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        firsts.append(first + base)
        anchors.append(h[chosen[first]])
    return np.concatenate(firsts), np.concatenate(anchors)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order; the text ends with its only 0.

    Suffixes are grouped by their Lyndon prefix, starting from their first symbol. Groups
    are processed from the highest down. A suffix's ``before`` is the nearest suffix to its
    left in a lower group, found by following earlier pointers over higher groups. Those
    that ``before`` names have their prefix extended by this group's once for each suffix
    that names them, so they move up: more repeats to a higher group. Nothing is renamed.
    Afterwards one pass in ascending order fills each group: the suffix left of the one just
    read is next in its group, and so are the ones its pointers lead to.
    """
    n = len(text)
    symbols = sorted(set(text))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    done = [False] * len(symbols)
    before = [-1] * n
    g = len(symbols) - 1
    while g >= 0:
        mine = [s for s in members[g] if group[s] == g]
        members[g] = mine
        done[g] = True
        named: dict[int, int] = {}
        for s in mine:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = before[p]
            before[s] = p
            if p >= 0:
                named[p] = named.get(p, 0) + 1
        if named:
            for times in sorted(set(named.values()), reverse=True):
                moved: dict[int, int] = {}
                for p, k in named.items():
                    if k == times:
                        old = group[p]
                        new = moved.get(old)
                        if new is None:
                            moved[old] = new = len(members)
                            members.append([])
                            done.append(False)
                            up = above[old]
                            above.append(up)
                            below.append(old)
                            above[old] = new
                            if up >= 0:
                                below[up] = new
                        group[p] = new
                        members[new].append(p)
        g = below[g]
    # From the lowest group up.
    free = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    order, placed = [-1] * n, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    free[group[n - 1]] += 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return order


def _digest(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _chunks(first: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Numbers of the segments that begin a chunk."""
    cut = (mix(anchor) & np.uint64(CHUNK - 1)) == 0
    cut[0] = True
    return np.flatnonzero(cut)


class Spans:
    """Covered spans of documents, neighbours put together."""

    def __init__(self) -> None:
        self.rows: list[list[int]] = []

    def add(self, doc: int, mark: int, start: int, stop: int) -> None:
        last = self.rows[-1] if self.rows else None
        if last and last[0] == doc and last[1] == mark and last[2] <= start <= last[3]:
            last[3] = max(stop, last[3])
        else:
            self.rows.append([doc, mark, start, stop])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """Ids, marks and texts of a few batches at a time."""
    docs, marks, texts, size = [], [], [], 0
    for batch in batches:
        docs += batch["doc"].to_pylist()
        marks += batch["mark"].to_pylist()
        texts += utf8(batch["text"])
        size += batch.nbytes
        if size >= BLOCK:
            yield docs, marks, texts
            docs, marks, texts, size = [], [], [], 0
    yield docs, marks, texts


_PIECES = "a bigint, b bigint, doc bigint, mark bigint, start bigint, stop bigint, body binary"


def _pieces(rows: list[tuple], spans: Spans) -> pa.RecordBatch:
    """Pieces with keys, and spans as rows without."""
    rows = rows + [(None, None, *r, None) for r in spans.rows]
    columns = list(zip(*rows)) if rows else [[]] * 7
    names = ["a", "b", "doc", "mark", "start", "stop"]
    out = {n: pa.array(columns[i], pa.int64()) for i, n in enumerate(names)}
    return pa.record_batch(out | {"body": pa.array(columns[6], pa.binary())})


def _once(found: list[tuple], spans: Spans) -> list[tuple]:
    """Of pieces ``(a, b, doc, mark, start, stop, body)`` with equal keys the first place; the
    others are covered. Equal places all stay."""
    first: dict[tuple[int, int], tuple[int, int]] = {}
    for r in found:
        place = (r[2], r[4])
        if first.setdefault(r[:2], place) > place:
            first[r[:2]] = place
    rest = []
    for r in found:
        if first[r[:2]] == (r[2], r[4]):
            rest.append(r)
        else:
            spans.add(*r[2:6])
    return rest


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their digests."""
    for docs, marks, texts in _shards(batches):
        found, spans = [], Spans()
        for i, first, stop, anchor in segments(texts):
            cuts = _chunks(first, anchor)
            ends = np.append(cuts[1:], len(first)) - 1
            for x, y in zip(first[cuts].tolist(), (stop[ends] + LENGTH - 1).tolist()):
                found.append((*_digest(texts[i][x:y]), docs[i], marks[i], x, y, None))
        yield _pieces(_once(found, spans), spans)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, c)``: an anchor with the least and the greatest of the chunks that hold it. An
    anchor that a chunk holds twice gets a second, made-up chunk."""
    for _, _, texts in _shards(batches):
        anchors, chunks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, first, stop, anchor in segments(texts):
            cuts = _chunks(first, anchor)
            ends = np.append(cuts[1:], len(first))
            digests = [
                _digest(texts[i][x:y])[0]
                for x, y in zip(first[cuts].tolist(), (stop[ends - 1] + LENGTH - 1).tolist())
            ]
            number = np.repeat(np.arange(len(cuts)), ends - cuts)
            chunk = np.array(digests, np.int64)[number]
            order = np.lexsort([number, anchor])
            twice = (anchor[order][1:] == anchor[order][:-1]) & (number[order][1:] == number[order][:-1])
            again = order[1:][twice]
            anchors += [anchor, anchor[again]]
            chunks += [chunk, ~chunk[again]]
        a, c = np.concatenate(anchors).view(np.int64), np.concatenate(chunks)
        order = np.lexsort([c, a])
        a, c = a[order], c[order]
        edge = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        low = np.flatnonzero(edge)
        high = np.append(low[1:], len(a)) - 1 if len(a) else low
        high = high[c[high] != c[low]]
        keep = np.concatenate([low, high])
        yield pa.record_batch({"a": pa.array(a[keep]), "c": pa.array(c[keep])})


def _segment_rows(wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of the wanted anchors, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for docs, marks, texts in _shards(batches):
            found, spans = [], Spans()
            for i, first, stop, anchor in segments(texts):
                hit = has_bit(bits, anchor, ANCHOR_BITS)
                for a, x, y in zip(
                    anchor[hit].view(np.int64).tolist(), first[hit].tolist(), (stop[hit] + LENGTH - 1).tolist()
                ):
                    body = texts[i][x:y]
                    found.append((a, _digest(body)[0], docs[i], marks[i], x, y, body))
            yield _pieces(_once(found, spans), spans)

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the given segments as a piece of its own."""
    for batch in batches:
        found, spans = [], Spans()
        for r in batch.to_pylist():
            for x in range(len(r["body"]) - LENGTH + 1):
                at = r["start"] + x
                found.append((*_digest(r["body"][x : x + LENGTH]), r["doc"], r["mark"], at, at + LENGTH, None))
        yield _pieces(_once(found, spans), spans)


_SPANS = "doc bigint, mark bigint, start bigint, stop bigint"


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    """Covered spans among the segments of one shard, each of them there once."""
    spans = Spans()
    found = [(0, 0, d, m, x, 0, b) for d, m, x, b in zip(*(rows[c] for c in ("doc", "mark", "start", "body")))]
    size = -1
    while found and size != sum(len(r[6]) for r in found):
        size = sum(len(r[6]) for r in found)
        # Equal stretches stand for their first place, after which fewer windows recur.
        stretches = [
            (*_digest(body), *found[i][2:4], found[i][4] + x, found[i][4] + x + len(body), body)
            for i, x, body in _stretches([r[6] for r in found])
        ]
        found = _once(sorted(stretches), spans)
    if found:
        places = np.array([(r[2], r[3], r[4]) for r in found], np.int64)
        sizes = [len(r[6]) for r in found]
        # 1 parts the strings, 0 ends the text; bytes follow from 2 on.
        text = np.concatenate([np.append(np.frombuffer(r[6], np.uint8).astype(np.int64) + 2, 1) for r in found] + [[0]])
        owner = np.repeat(np.arange(len(found)), np.array(sizes) + 1)
        begins = np.cumsum([0] + [n + 1 for n in sizes[:-1]])
        offset = np.arange(len(owner)) - begins[owner]
        order = np.array(suffix_array(text.tolist()))
        order = order[order < len(owner)]
        order = order[offset[order] <= np.array(sizes)[owner[order]] - LENGTH]
        view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
        same = np.zeros(len(order), bool)
        for at in range(1, len(order), 4096):
            mine = order[at : at + 4096]
            same[at : at + 4096] = (view[mine] == view[order[at - 1 : at - 1 + len(mine)]]).all(1)
        group = np.cumsum(~same)
        doc, start = places[owner[order], 0], places[owner[order], 2] + offset[order]
        by = np.lexsort([start, doc, group])
        lead = by[np.concatenate([[True], group[by][1:] != group[by][:-1]])]
        later = (doc != doc[lead][group - 1]) | (start != start[lead][group - 1])
        mark = places[owner[order], 1]
        for d, m, x in sorted(zip(doc[later].tolist(), mark[later].tolist(), start[later].tolist())):
            spans.add(d, m, x, x + LENGTH)
    return pd.DataFrame(spans.rows, columns=["doc", "mark", "start", "stop"])


def _stretches(bodies: list[bytes]) -> list[tuple[int, int, bytes]]:
    """Parts of the segments whose windows' hashes recur: segment, start in it, bytes."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    h = gram_hashes(raw, LENGTH)
    begin = np.cumsum([0] + [len(b) for b in bodies])
    valid = np.zeros(len(h), bool)
    for a, b in zip(begin[:-1], begin[1:]):
        valid[a : b - LENGTH + 1] = True
    _, inverse, count = np.unique(h[valid], return_inverse=True, return_counts=True)
    again = np.zeros(len(raw) + 1, np.int8)
    again[np.flatnonzero(valid)] = count[inverse] > 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], again])))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        i = int(np.searchsorted(begin, a, "right")) - 1
        out.append((i, a - int(begin[i]), raw[a : b + LENGTH - 1].tobytes()))
    return out


def _later(pieces: DataFrame) -> DataFrame:
    """Covered spans of pieces that occurred earlier."""
    keys = (
        pieces.where("a is not null")
        .groupBy("a", "b")
        .agg(F.min(F.struct("doc", "start")).alias("lead"), F.max(F.struct("doc", "start")).alias("last"))
    )
    several = keys.where("lead <> last").drop("last")
    both = pieces.where("a is not null").join(several, ["a", "b"])
    direct = pieces.where("a is null").select("doc", "mark", "start", "stop")
    return both.where(F.struct("doc", "start") != F.col("lead")).select("doc", "mark", "start", "stop").union(direct)


def _settled(pieces: DataFrame) -> DataFrame:
    """``(a, doc, mark, start, stop, body)``: pieces at their first place with their body, covered spans without."""
    keyed = pieces.where("a is not null")
    leads = keyed.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("lead"))
    body = F.when(F.struct("doc", "start") == F.col("lead"), F.col("body")).alias("body")
    out = keyed.join(leads, ["a", "b"]).select("a", "doc", "mark", "start", "stop", body)
    return out.union(pieces.where("a is null").select("a", "doc", "mark", "start", "stop", "body"))


def covered_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, mark, start, stop)``: spans of bytes to remove, per id and hash of the text."""
    spark = docs.sparkSession
    texts = _marked(docs, id_col, text_col)
    chunks = staged(texts.mapInArrow(_chunk_rows, _PIECES).drop("body"), "chunks")
    of_chunks = staged(_later(chunks), "chunk_spans")
    discard(chunks)

    # Rows of one anchor meet after each task has left two of it at most.
    anchors = texts.mapInArrow(_anchor_rows, "a bigint, c bigint").repartition("a")
    several = anchors.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    several = staged(several.select("a"), "anchors")
    wanted = spark.sparkContext.broadcast(bit_set(several, F.col("a"), ANCHOR_BITS))
    found = staged(texts.mapInArrow(_segment_rows(wanted), _PIECES), "segments")
    settled = staged(_settled(found), "distinct_segments")
    discard(found)
    of_segments = settled.where("body is null").select("doc", "mark", "start", "stop")
    firsts = settled.where("body is not null")

    hot = firsts.groupBy("a").count().where(F.col("count") > HOT).select("a")
    hot = staged(hot, "hot_anchors")
    windows = staged(firsts.join(hot, "a", "left_semi").mapInArrow(_window_rows, _PIECES).drop("body"), "windows")
    of_windows = staged(_later(windows), "window_spans")
    discard(windows)

    rest = firsts.join(hot, "a", "left_anti")
    size = firsts.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    of_shards = (
        rest.withColumn("shard", F.pmod("a", F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_sorted, _SPANS)
    )
    return of_chunks.union(of_segments).union(of_windows).union(of_shards)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )


_CLEANED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(utf8(batch["text"]), batch["spans"].to_pylist()):
            runs = Spans()
            for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                runs.add(0, 0, *s)
            kept, at = [], 0
            for _, _, start, stop in runs.rows:
                kept.append(text[at:start])
                at = stop
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(runs.rows), kept))
        names = ["n_bytes", "n_removed", "n_spans"]
        out = {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}
        yield pa.record_batch({"row": batch["row"]} | out | {"kept": pa.array([r[3] for r in rows], pa.binary())})


def remove_repeats(
    docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row`` (a struct of the kept columns), ``n_bytes``, ``n_removed``, ``n_spans`` and the
    ``kept`` bytes of every document."""
    spans = (
        covered_spans(docs, id_col, text_col)
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )
    spans = staged(spans, "spans")
    row = F.struct(*[docs[c] for c in keep]).alias("row")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        row,
        text.alias("text"),
        F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64(text).alias("mark"),
    )
    # Only texts that may have spans are shuffled to meet them.
    named = docs.sparkSession.sparkContext.broadcast(bit_set(spans, F.xxhash64("doc"), DOC_BITS))
    spanned = _in_bits(named)(F.xxhash64("doc"))
    met = rows.where(spanned).join(spans, ["doc", "mark"], "left").select("row", "text", "spans")
    whole = rows.where(~spanned).select("row", "text", F.lit(None).cast(met.schema["spans"].dataType).alias("spans"))
    kind = rows.schema["row"].dataType.simpleString()
    return met.union(whole).mapInArrow(_cleaned, f"row {kind}, {_CLEANED}")


def _in_bits(named) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def inside(hashes: pd.Series) -> pd.Series:
        bits = np.frombuffer(named.value, np.uint8)
        return pd.Series(has_bit(bits, hashes.to_numpy().view(np.uint64), DOC_BITS))

    return inside


def repeat_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every document."""
    out = remove_repeats(docs, ["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
