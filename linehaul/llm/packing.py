"""Token sequences for training: concatenate all documents and cut at fixed windows.

Pass one tokenizes every text and writes it with the number of its write task and its
place among that task's tokens. Per task one total remains; prefix sums over blocks of
tasks and within a block give every task's offset in the corpus. Pass two adds the
offset, so each document knows by itself which windows it meets, and cuts its ids at
their borders: no shuffle of tokens, no order to agree on. A document that crosses a
border leaves one record per window. Only the last sequence can be short.

Words between ASCII white space are tokenized once and kept in a table of bounded size,
since the tokenizer's normaliser and pre-tokenizer never look across white space. (This
holds for tokenizers that lower-case, drop white space and part letters from signs.) New
words of letters alone are encoded many at once, as one text, where the model marks ends
of words; signs after such a word are looked up apart from it.

Defined results: null and empty texts are the end id alone. Repeated rows and null ids
are documents like others. An empty table has no pieces. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linehaul.llm.hashing import utf8
from linehaul.llm.stage import keyed, staged

#: Words kept with their ids in a Python worker (some 200 bytes each), and the longest of
#: them in bytes.
KEPT_WORDS, KEPT_BYTES = 1_500_000, 32
#: A plain word, small letters up to U+00FF that no normaliser of that kind changes, and the ASCII signs after it.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)").fullmatch
#: Plain words encoded as one text.
JOINED = 512
#: Tasks of one block of prefix sums.
BLOCK = 1024
#: Bytes of an id: unsigned, little-endian.
WIDTH = 4


class WordIds:
    """Ids of whole texts as little-endian bytes, through a table of words."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.known: dict[bytes, bytes] = {}
        # Plain words need no normaliser, and no pattern to part letters from signs.
        self.plain = Tokenizer.from_file(tokenizer_file)
        self.plain.normalizer = None
        bytes_alone = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_alone])
        end = getattr(self.plain.model, "end_of_word_suffix", None)
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.ends[[i for t, i in vocabulary.items() if end and t.endswith(end)]] = True
        # Asked for, not assumed: a tokenizer of another kind encodes every word by itself.
        letters = [chr(c).encode() for c in range(256) if _PLAIN(chr(c).encode())]
        letters.append(b"".join(letters))
        self.joins = self._joined(letters) == self._encode(letters)

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found)}

    def _joined(self, words: list[bytes]) -> dict[bytes, bytes] | None:
        """Ids of plain words encoded as one text, cut after the ids that end a word; none if those are not as many."""
        text = b" ".join(words).decode()
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * WIDTH).tolist()
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends)} if len(ends) == len(words) else None

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Put words that the table lacks into it; signs after a plain word are encoded apart from it.
        Those too long to stay are returned."""
        known = self.known
        cut = {w: m.groups() for w in words if self.joins and (m := _PLAIN(w))}
        plain = [w for w in {w for w, _ in cut.values()} if w not in known]
        others = [w for w in words.difference(cut).union(s for _, s in cut.values() if s) if w not in known]
        known.update(self._encode(others))
        for k in range(0, len(plain), JOINED):
            part = plain[k : k + JOINED]
            known.update(self._joined(part) or self._encode(part))
        for w, (stem, signs) in cut.items():
            if signs:
                known[w] = known[stem] + known[signs]
        return [w for w in {*words, *plain, *others} if len(w) > KEPT_BYTES]

    def many(self, texts: list[bytes]) -> list[bytes]:
        # A special token must not come about by lower-casing.
        words = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        known = self.known
        out = [list(map(known.get, w)) for w in words]
        holes = [[k for k, ids in enumerate(o) if ids is None] for o in out]
        new = {w[k] for w, h in zip(words, holes) for k in h}
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
        long = self._learn(new)
        for w, o, h in zip(words, out, holes):
            for k in h:
                o[k] = known[w[k]]
        for w in long:
            del known[w]
        return [b"".join(o) for o in out]

    def __call__(self, text: bytes) -> bytes:
        return self.many([text])[0]


@cache
def word_ids(tokenizer_file: str) -> WordIds:
    """One table for all tasks of a Python worker."""
    return WordIds(tokenizer_file)


def _tokenized(tokenizer_file: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_file)
        task = TaskContext.get().partitionId()
        last = end.to_bytes(WIDTH, "little")
        at = 0
        for batch in batches:
            ids = [i + last for i in ids_of.many(utf8(batch["text"]))]
            sizes = [len(i) // WIDTH for i in ids]
            places = []
            for n in sizes:
                places.append(at)
                at += n
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "task": pa.array([task] * len(ids), pa.int64()),
                    "at": pa.array(places, pa.int64()),
                    "n": pa.array(sizes, pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                }
            )

    return run


def _offsets(tokens: DataFrame) -> DataFrame:
    """``(task, base)``: the tokens before each task's, by block sums and sums within blocks."""
    totals = tokens.groupBy("task").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"task div {BLOCK}"))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_base"))
    inside = Window.partitionBy("block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select(
        "task", (F.col("base") + F.col("block_base")).alias("base")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end: int = 2,
) -> DataFrame:
    """One row a piece: ``id``, ``start`` (its document's ids before it), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence`` and ``offset`` in it."""
    texts = keyed(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    schema = "id bigint, task bigint, at bigint, n bigint, ids binary"
    tokens = staged(texts.mapInArrow(_tokenized(tokenizer_file, end), schema), "tokens", "zstd")
    # One small row per write task. Written first, so that Spark knows its size: it is
    # broadcast below the session's threshold and shuffled beyond.
    offsets = staged(_offsets(tokens), "offsets")
    placed = tokens.join(offsets, "task").withColumn("first", F.col("base") + F.col("at"))
    pieces = placed.withColumn(
        "sequence", F.explode(F.expr(f"sequence(first div {window}, (first + n - 1) div {window})"))
    )
    start = F.greatest("first", F.col("sequence") * window) - F.col("first")
    stop = F.least(F.col("first") + F.col("n"), (F.col("sequence") + 1) * window) - F.col("first")
    cut = pieces.withColumn("start", start).withColumn("length", stop - start)
    return cut.select(
        "id",
        "start",
        "length",
        F.expr(f"substring(ids, cast(start * {WIDTH} + 1 as int), cast(length * {WIDTH} as int))").alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence",
        (F.col("first") + F.col("start") - F.col("sequence") * window).alias("offset"),
    )


def assemble(pieces: DataFrame) -> DataFrame:
    """Whole sequences: ``sequence``, ``ids`` and the documents' ``spans`` in it. A group is
    one window, so its size is bounded."""
    grouped = pieces.groupBy("sequence").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "id", "start", "ids"))).alias("parts")
    )
    ids = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return grouped.select(
        "sequence", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("spans")
    )


def piece_report(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack_documents(docs, tokenizer_file).select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("sequence").alias("sequence_id"),
        "offset",
    )
