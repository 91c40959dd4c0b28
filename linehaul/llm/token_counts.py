"""Token counts of whole texts under a unigram vocabulary, through tries of their words.

A text is cut into words at ASCII white space; a word starts with the mark that stands for
the space before it. Its best segmentation into vocabulary pieces has the least sum of
costs. The best sum over a prefix does not depend on what follows, so words are put into a
trie and each node's forward value is computed once, from its ancestors' values and the
pieces that end there; a word's end stores its number of tokens. Tasks build the trie from
the distinct new words of a few texts at a time and keep the counts of words in a table of
bounded size. Texts are then sums over their words; nothing is shuffled.

The vocabulary lists pieces by falling frequency, and a piece's cost is the logarithm of
its place, as for a unigram model under Zipf's law. A character without a piece is spelled
as its UTF-8 bytes, each dearer than any piece. Equal costs go to fewer tokens.

Defined results: null, empty and blank texts have no words and no tokens. Repeated rows and
null ids are counted like others. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linehaul.llm.hashing import utf8
from linehaul.llm.stage import keyed

#: Counts of words kept in a Python worker, and the longest of them in characters.
KEPT_WORDS, KEPT_CHARS = 300_000, 64
#: Bytes of texts whose new words share a trie.
SHARE_BYTES = 4 << 20
#: Stands before every word.
SPACE = "▁"
#: Costs are whole millionths above the token count in the low bits.
_BITS = 32


class Unigram:
    """Piece costs by piece, with every tail of a piece that is none itself as ``None``."""

    def __init__(self, pieces: list[str]):
        costs = {p: (round(1e6 * log(i + 2)) << _BITS) + 1 for i, p in reversed([*enumerate(pieces)])}
        self.byte = (round(1e6 * log(len(pieces) + 2)) + 1 << _BITS) + 1
        self.costs: dict[str, int | None] = dict(costs)
        for p in costs:
            for i in range(1, len(p)):
                self.costs.setdefault(p[i:], None)

    @classmethod
    def from_file(cls, model_file: str) -> Unigram:
        """The ordinary pieces of a SentencePiece model, in their order."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        return cls([model.id_to_piece(i) for i in ids if not any(f(i) for f in special)])

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of every word. Sorted words visit the trie depth first: ``path`` is the
        branch at hand and ``best`` has its nodes' forward values."""
        costs, spell = self.costs, self.byte
        out: dict[str, int] = {}
        path, best = "", [0]
        for word in sorted(set(words)):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                least = best[-1] + spell * len(word[end - 1].encode("utf-8", "surrogatepass"))
                start = end - 1
                while start >= 0:
                    tail = word[start:end]
                    if tail not in costs:
                        break
                    cost = costs[tail]
                    if cost is not None and best[start] + cost < least:
                        least = best[start] + cost
                    start -= 1
                best.append(least)
            path = word
            out[word] = best[-1] & (1 << _BITS) - 1
        return out


def _counted(model_file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.from_file(model_file)
        known: dict[bytes, int] = {}
        held: list[pa.RecordBatch] = []
        size = 0

        def count() -> Iterator[pa.RecordBatch]:
            words = [[t.split() for t in utf8(b["text"])] for b in held]
            new = {w for texts in words for text in texts for w in text if w not in known}
            marked = {w: SPACE + w.decode("utf-8", "replace") for w in new}
            counts = model.counts(list(marked.values()))
            found = {w: counts[m] for w, m in marked.items()}
            table = known | found if len(known) + len(found) > KEPT_WORDS else known
            if table is known:
                known.update(found)
            for batch, texts in zip(held, words):
                yield pa.record_batch(
                    {
                        "id": batch["id"],
                        "n_words": pa.array([len(w) for w in texts], pa.int64()),
                        "n_tokens": pa.array([sum(map(table.__getitem__, w)) for w in texts], pa.int64()),
                    }
                )
            if table is not known:
                known.clear()
                known.update((w, n) for w, n in found.items() if len(w) <= KEPT_CHARS)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARE_BYTES:
                yield from count()
                held, size = [], 0
        yield from count()

    return run


def token_counts(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_words, n_tokens)`` of every document."""
    texts = keyed(docs, id_col, text_col).withColumnRenamed(text_col, "text")
    return texts.mapInArrow(_counted(model_file), "id bigint, n_words bigint, n_tokens bigint")


def token_report(docs: DataFrame, model_file: str) -> DataFrame:
    return token_counts(docs, model_file).select(F.col("id").alias("doc_id"), "n_words", "n_tokens")
