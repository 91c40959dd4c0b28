"""Repeated lines: a sharded minimal perfect hash of line hashes, probed by the documents.

Every line that counts gets two 64-bit hashes of its key. Keys found in two or more
documents are spread over shards of a few thousand keys. A shard is one row of arrays:
displacements that send each of its ``n`` keys to a slot of its own in ``0..n-1``, and
per slot a fingerprint, the number of lines and the smallest document id. Documents send
each line's hashes to its shard, look up one slot and compare the fingerprint; no line
text is joined, and a shard in demand is split by Spark's skew handling, since it is one
small row on the other side.

Defined results: a null text is one empty line. A null id counts as one document, after
all others. Rows of one id are one document. An empty table gives an empty table. Extra
columns are kept by :func:`drop_repeated_lines` and play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.stage import staged

#: Bytes stripped at both ends of a line's key.
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = 2**63 - 1
#: Keys of one shard, about; a shard row takes some 25 bytes a key.
SHARD_KEYS = 4096
_SHARD = (
    "shard int, n int, turn int, steps array<int>, prints array<bigint>, "
    "lines array<bigint>, holders array<bigint>"
)
#: 2**31 - 1, a prime; the low 31 bits of a number.
_MASK = (1 << 31) - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(91), key).alias("h2")]


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(doc, h1, h2)`` of every line whose key has ``min_chars`` code points or more."""
    lines = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("doc"),
        F.explode(text_lines(docs[text_col])).alias("line"),
    )
    key = line_key(F.col("line"))
    return lines.where(F.char_length(key) >= min_chars).select("doc", *_hashes(key))


def line_index(lines: DataFrame) -> DataFrame:
    """Shards of the keys that two or more documents hold, one row a shard.

    Counting combines within each task first, so a line that is everywhere leaves
    each task as one row.
    """
    keys = (
        lines.groupBy("h1", "h2")
        .agg(F.min("doc").alias("holder"), F.max("doc").alias("last"), F.count("*").alias("lines"))
        .where("holder <> last")
        .drop("last")
    )
    keys = staged(keys, "line_keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    return (
        keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(_build, _SHARD)
        .withColumn("shards", F.lit(shards))
    )


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's arrays: keys fall into buckets by ``h1``; a bucket, largest first,
    takes the first step that sends all its keys to free slots. A bucket of one key
    names its slot directly, as a negative step."""
    rows = rows.sort_values(["h1", "h2"]).reset_index(drop=True)
    n = len(rows)
    buckets = _buckets(n)
    h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
    bucket = (h1 >> 32) % buckets
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    groups.sort(key=len, reverse=True)
    for turn in range(20):
        first, second = (h2 >> turn) & _MASK, (h2 >> (turn + 12)) & _MASK
        steps, slot = np.zeros(buckets, np.int32), np.full(n, -1)
        taken = np.zeros(n, bool)
        for g in groups:
            if len(g) == 1:
                break
            for d in range(1 << 16):
                s = (first[g] + d * second[g]) % _MASK % n
                if not taken[s].any() and len(np.unique(s)) == len(g):
                    break
            else:
                break
            steps[bucket[g[0]]], slot[g], taken[s] = d, s, True
        else:
            g = []
        if len(g) < 2:
            break
    else:
        raise ValueError("no perfect hash was found for a shard")
    single = [g[0] for g in groups if len(g) == 1]
    free = np.flatnonzero(~taken)
    slot[single], steps[bucket[single]] = free, -free - 1
    at = np.argsort(slot)
    one = {"shard": rows["shard"].iloc[0], "n": n, "turn": turn, "steps": steps, "prints": h1[at]}
    one |= {"lines": rows["lines"].to_numpy()[at], "holders": rows["holder"].to_numpy()[at]}
    return pd.DataFrame([one])


def _buckets(n: int) -> int:
    return n // 2 + 1


def probe(lines: DataFrame, index: DataFrame) -> DataFrame:
    """``(doc, h1, h2, lines, holder)`` of the lines that the index has."""
    shards = index.select("shards").first()
    if shards is None:
        return lines.limit(0).select("*", F.lit(0).alias("lines"), F.lit(0).alias("holder"))
    at = lines.withColumn("shard", F.pmod("h1", F.lit(shards[0])).cast("int"))
    both = at.join(index.hint("shuffle_hash"), "shard")
    step = "element_at(steps, cast(pmod(shiftright(h1, 32), n div 2 + 1) as int) + 1)"
    slot = (
        f"if({step} < 0, -{step} - 1, cast(((shiftright(h2, turn) & {_MASK}) + "
        f"{step} * (shiftright(h2, turn + 12) & {_MASK})) % {_MASK} % n as int)) + 1"
    )
    found = both.withColumn("slot", F.expr(slot)).where("element_at(prints, slot) = h1")
    return found.select(
        "doc", "h1", "h2",
        F.expr("element_at(lines, slot)").alias("lines"),
        F.expr("element_at(holders, slot)").alias("holder"),
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10
) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` and ``n_dropped`` added, which take the
    place of columns of these names.

    A line goes where its key is in the index and another document of a smaller id holds it.
    """
    lines = staged(line_hashes(docs, id_col, text_col, min_chars), "line_hashes")
    index = staged(line_index(lines), "line_index")
    drops = (
        probe(lines, index)
        .where("doc <> holder")
        .groupBy("doc")
        .agg(F.collect_set("h1").alias("_drop"))
        .withColumnRenamed("doc", "_doc")
    )
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("_doc"),
        text_lines(docs[text_col]).alias("ls"),
    ).join(drops, "_doc", "left")
    gone = lambda line: (F.char_length(line_key(line)) >= min_chars) & F.array_contains(
        F.col("_drop"), F.xxhash64(line_key(line))
    )
    kept = F.when(F.col("_drop").isNull(), F.col("ls")).otherwise(F.filter("ls", lambda line: ~gone(line)))
    added = ("kept_text", "n_lines", "n_dropped")
    return rows.withColumn("kept", kept).select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in added],
        F.array_join("kept", "\n").alias("kept_text"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every document."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), "doc_id", "text", min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
