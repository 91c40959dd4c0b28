"""Spelling variants: words one edit apart, grouped under their most frequent form.

The vocabulary is a table of words and counts. A blocked Bloom filter, sharded by word
length, is built from it and broadcast; each word's edits (every deletion of a letter, every
replacement by a later letter) are made as hashes and probed against the shard of their
length. Insertions and the other replacements are the same pairs seen from the other
word. Only edits that the filter lets through leave their task, as two hashes; a join with
the vocabulary by hash and an edit distance of one remove false positives, so the filter's
size changes the cost and never the result.

The filter holds ``BITS`` bits a word, at most ``MOST_BLOCKS`` blocks of 64 bits in all
(32 MB), built by Spark's bitmap aggregates; beyond that more edits pass it. Words longer than
``LONGEST_SHARD`` letters share one shard. No group is ever collected: a word of L letters
has at most 90 * (2 * L + 1) words near it, and forms are followed by jumps of doubling
length, written out between rounds.

Defined results: null and empty texts have no words. A run of letters of any length is a word like others.
Repeated rows count each time. Without an id no letter of a run is deleted. An empty table
gives no words. Words tie by code points. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.hashing import mix
from linehaul.llm.stage import bit_set, keyed, staged

#: Letters: runs of them are words. A-Z are lower-cased, so these letters remain.
RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
#: Bits a word and bits set by it, all in one block of 64.
BITS, SET = 16, 4
#: Blocks of all shards together: 2 ** 22 of 8 bytes are 32 MB.
MOST_BLOCKS = 1 << 22
#: Words of this many letters or more are one shard.
LONGEST_SHARD = 64
#: Words and letters whose edits are made at once.
CHUNK_WORDS, CHUNK_LETTERS = 8192, 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_VALUES = np.random.default_rng(11).integers(1, 2**63, 0x100, dtype=np.uint64)


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, word)`` of every run of letters of every whole text."""
    texts = keyed(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    runs = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    return runs.select("id", lower_ascii(F.col("run")).alias("word"))


def drop_letters(runs: DataFrame, every: int) -> DataFrame:
    """The runs, less one letter where ``every`` divides the crc32 of ``id:word``: that at crc32 modulo length."""
    crc = F.crc32(F.concat_ws(":", F.col("id").cast("string"), "word"))
    at = (F.col("crc") % F.char_length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    hit = F.col("id").isNotNull() & (F.col("crc") % every == 0)
    return runs.withColumn("crc", crc).select("id", F.when(hit, less).otherwise(F.col("word")).alias("word"))


def word_counts(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``(word, n)`` of the words long and frequent enough; counts combine within each task."""
    long = words.where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _shard(size: np.ndarray | int) -> np.ndarray | int:
    return np.minimum(size, LONGEST_SHARD)


class Letters:
    """Words of one length as rows of letters, with the hashes of their edits."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.codes = codes.reshape(len(words), -1)
        size = self.codes.shape[1]
        powers = np.full(size, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.values = _VALUES[self.codes] * self.powers
        self.sums = np.cumsum(self.values, 1, dtype=np.uint64)

    def hashes(self) -> np.ndarray:
        return mix(self.sums[:, -1] + np.uint64(self.codes.shape[1]))

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every word with a letter less; of equal neighbours the first goes."""
        once = np.ones(self.codes.shape, bool)
        once[:, 1:] = self.codes[:, 1:] != self.codes[:, :-1]
        row, at = np.nonzero(once)
        until = self.sums[row, at]
        rest = (self.sums[row, -1] - until) * _INVERSE
        size = np.uint64(self.codes.shape[1] - 1)
        return row, mix(until - self.values[row, at] + rest + size)

    def replacements(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for every letter put in place of an earlier one."""
        size = np.uint64(self.codes.shape[1])
        for letter in LETTERS:
            row, at = np.nonzero(self.codes < letter)
            value = _VALUES[letter] * self.powers[at]
            yield row, mix(self.sums[row, -1] - self.values[row, at] + value + size)


class Filter:
    """Places in the blocked filter, and the probe."""

    def __init__(self, counts: dict[int, int]):
        total = sum(max(1, -(-n * BITS // 64)) for n in counts.values())
        share = min(1.0, MOST_BLOCKS / max(total, 1))
        self.first = np.zeros(LONGEST_SHARD + 1, np.uint64)
        self.blocks = np.zeros(LONGEST_SHARD + 1, np.uint64)
        at = 0
        for size, n in sorted(counts.items()):
            self.first[size] = at
            self.blocks[size] = max(1, int(-(-n * BITS // 64) * share))
            at += int(self.blocks[size])
        #: All places are below two to this power.
        self.power = max(15, (at * 64 - 1).bit_length()) if at else 15

    def places(self, shard: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and its bits in the block."""
        block = self.first[shard] + (((hashes >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32))
        bits = [(hashes >> np.uint64(6 * k)) & np.uint64(63) for k in range(SET)]
        return block, np.stack(bits)

    def passes(self, filled: np.ndarray, shard: int, hashes: np.ndarray) -> np.ndarray:
        if not self.blocks[shard]:
            return np.zeros(len(hashes), bool)
        block, bits = self.places(shard, hashes)
        mask = np.bitwise_or.reduce(np.uint64(1) << bits, axis=0)
        return filled[block.astype(np.int64)] & mask == mask


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Length and numbers of words of one length, not too many letters at once."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for size, numbers in groups.items():
        step = max(1, CHUNK_LETTERS // size)
        for k in range(0, len(numbers), step):
            yield size, numbers[k : k + step]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch["word"].to_pylist()
        out = np.zeros(len(words), np.uint64)
        for _, numbers in _by_length(words):
            out[numbers] = Letters([words[k] for k in numbers]).hashes()
        size = np.array([len(w) for w in words], np.int32)
        columns = {"word": batch["word"], "n": batch["n"], "h": pa.array(out.view(np.int64)), "shard": pa.array(_shard(size), pa.int32())}
        yield pa.record_batch(columns)


def _set_bits(layout: Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, shard = batch["h"].to_numpy().view(np.uint64), batch["shard"].to_numpy()
            block, bits = layout.places(shard, h)
            yield pa.record_batch({"place": pa.array((block * np.uint64(64) + bits).ravel().astype(np.int64))})

    return run


def _probed(layout: Filter, filled) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def edits(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = np.frombuffer(filled.value, np.uint64)
        for size, numbers in _by_length(words):
            letters = Letters([words[k] for k in numbers])
            own = letters.hashes()
            if size > 1:
                row, h = letters.deletions()
                hit = layout.passes(bits, int(_shard(size - 1)), h)
                yield own[row[hit]], h[hit]
            for row, h in letters.replacements():
                hit = layout.passes(bits, int(_shard(size)), h)
                yield own[row[hit]], h[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def out() -> Iterator[pa.RecordBatch]:
            for a, b in edits(waiting):
                if len(a):
                    yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
            waiting.clear()

        for batch in batches:
            waiting += batch["word"].to_pylist()
            if len(waiting) >= CHUNK_WORDS:
                yield from out()
        yield from out()

    return run


def _vocabulary(counts: DataFrame) -> DataFrame:
    words = counts.select("word", F.col("n").cast("long")).where(F.col("word").rlike("^[a-zÀ-ÿ]+$"))
    return staged(words.mapInArrow(_hashed, "word string, n bigint, h bigint, shard int"), "words")


def near_words(counts: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs of words one edit apart, both ways round."""
    return _near(_vocabulary(counts))


def _near(words: DataFrame) -> DataFrame:
    spark = words.sparkSession
    layout = Filter({r["shard"]: r["n"] for r in words.groupBy("shard").agg(F.count("*").alias("n")).collect()})
    filled = bit_set(words.select("h", "shard").mapInArrow(_set_bits(layout), "place bigint"), F.col("place"), layout.power)
    edits = words.select("word").mapInArrow(_probed(layout, spark.sparkContext.broadcast(filled)), "a bigint, b bigint")
    a = words.select(F.col("h").alias("a"), F.col("word").alias("aw"), F.col("n").alias("an"))
    b = words.select(F.col("h").alias("b"), F.col("word").alias("bw"), F.col("n").alias("bn"))
    # False positives go with the first join; words whose hashes collide, with the distance.
    found = edits.join(b, "b").join(a, "a").where(F.levenshtein("aw", "bw", 1) == 1)
    pairs = staged(found.select("aw", "an", "bw", "bn").distinct(), "near-words")
    names = ["word", "n", "near", "near_n"]
    return pairs.toDF(*names).union(pairs.select("bw", "bn", "aw", "an").toDF(*names))


def variant_groups(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``counts`` (a row a word; what
    is no run of lower-case letters takes no part).

    A word's form is the near word of the largest count (ties: the first by code points)
    if that count is at least ``ratio`` times its own; its root is where the forms end.
    """
    words = _vocabulary(counts)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    per = _near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    per = staged(
        per.select(
            "word",
            "n_near",
            F.when(-F.col("best.order") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n"))).alias("to"),
        ),
        "forms",
    )
    forms = per.where("to is not null").select("word", F.col("to.form").alias("root"))
    roots = _followed(forms)
    return (
        words.select("word", "n")
        .join(per, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            F.col("to.form").alias("form"),
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.col("to.form_n").alias("form_n"),
        )
    )


def _followed(forms: DataFrame) -> DataFrame:
    """The forms' ends: every round doubles the steps taken, so few rounds do. Counts grow at each step, so there is no ring."""
    roots = staged(forms, "roots")
    while True:
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        new = staged(roots.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            return roots


def variant_report(docs: DataFrame) -> DataFrame:
    """The groups over the words of all texts, one letter lost in every 199th word of a document."""
    return variant_groups(word_counts(drop_letters(word_runs(docs), 199)))
