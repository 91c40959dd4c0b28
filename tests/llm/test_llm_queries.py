from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import plain
import pytest
from oracle_check import compare, duck

from linehaul.llm import queries, token_counts
from linehaul.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, duck(SF), SF, queries.QUERIES[name], ORACLE[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    rows = queries.op1_packing(spark, SF).collect()
    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in documents(spark)}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{r.length}I", *part)) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    gapless = lambda parts: all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    assert {i: sum(n for _, n in p) for i, p in seen.items()} == {i: len(x) for i, x in ids.items()}
    assert all(gapless(p) for p in [*seen.values(), *sequences.values()])
    sizes = [sum(n for _, n in sequences[s]) for s in sorted(sequences)]
    assert set(sizes[:-1]) <= {4096} and 0 < sizes[-1] <= 4096


def test_neighbours_recall(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op2_nearest_neighbours(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    found = wanted = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and mine.score.is_monotonic_increasing
        assert np.allclose(mine.score, far[np.searchsorted(ids, mine.vec_id)], rtol=1e-12)
        found += len(set(mine.vec_id) & set(ids[np.lexsort([ids, far])[:10]]))
        wanted += 10
    assert found >= 0.95 * wanted


def test_token_counts(spark):
    model = token_counts.Unigram.from_file(queries.piece_vocabulary())
    pieces = {p: c >> 32 for p, c in model.costs.items() if c is not None}
    counts = {}
    for r in queries.op3_token_counts(spark, SF).collect():
        counts[r.doc_id] = (r.n_words, r.n_tokens)
    for i, text in documents(spark)[:60]:
        words = (text or "").split()
        tokens = sum(plain.unigram_tokens(pieces, model.byte >> 32, "▁" + w) for w in words)
        assert counts[i] == (len(words), tokens)


def test_repeats(spark):
    got = {r[0]: tuple(r)[1:] for r in queries.op4_suffix_array_dedup(spark, SF).collect()}
    assert got == plain.repeats(documents(spark))


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    got = queries.op5_toxicity(spark, sf).toPandas()
    assert (got.held_out == got.doc_id.map(plain.held_out)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    known = got[got.held_out].merge(labels, on="doc_id")
    toxic, clean = known[known.toxic == 1], known[known.toxic == 0]
    assert len(toxic) > 50 and (toxic.predicted == 1).mean() >= 0.75 and (clean.predicted == 0).mean() >= 0.99
