from __future__ import annotations

import random
import zlib
from collections import Counter

import plain
import pytest

from linehaul.llm import variants
from linehaul.llm.stage import small_batches

LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def edits(word: str) -> set[str]:
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b} | {a + x + b for a, b in cuts for x in LETTERS}
    return (found | {a + x + b[1:] for a, b in cuts if b for x in LETTERS}) - {word}


def groups(counts: dict[str, int], ratio: int = 5) -> set[tuple]:
    near = {w: sorted(edits(w) & counts.keys(), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: n[0] if n and counts[n[0]] >= ratio * counts[w] else None for w, n in near.items()}

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def frame(spark, counts: dict[str, int]):
    return small_batches(spark).createDataFrame(list(counts.items()), "word string, n int")


def found(df) -> set[tuple]:
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(seed: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abéÿ", k=rng.randint(1, 5))) for _ in range(150)]
    long = "x" * 70 + "y" * 3000
    return {w: rng.choice([1, 5, 5, 25, 125, 700]) for w in words} | {long: 40, long + "y": 5, long[1:]: 1, "z" + long[1:]: 200}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_random_words(spark, seed):
    counts = vocabulary(seed)
    assert found(variants.variant_groups(frame(spark, counts))) == groups(counts)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "MOST_BLOCKS", 1)
    counts = vocabulary(3)
    assert found(variants.variant_groups(frame(spark, counts))) == groups(counts)


def test_near_words_come_both_ways(spark):
    rows = variants.near_words(frame(spark, {"abc": 1, "abd": 2, "abcd": 3, "xyz": 4})).collect()
    assert sorted((r.word, r.near) for r in rows) == sorted(
        [("abc", "abd"), ("abd", "abc"), ("abc", "abcd"), ("abcd", "abc"), ("abd", "abcd"), ("abcd", "abd")]
    )


def test_forms_are_followed_to_the_end(spark):
    counts = {"a" * k: 5**k for k in range(1, 12)}
    rows = variants.variant_groups(frame(spark, counts)).collect()
    assert {r.root for r in rows} == {"a" * 11}


def test_words_of_texts(spark):
    texts = [(1, "Straße straßE ÀB12ab"), (1, "Straße straßE ÀB12ab"), (2, None), (3, ""), (None, "abc"), (4, "q" * 100_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    words = [tuple(r) for r in variants.word_runs(docs).collect()]
    want = [(i, w) for i in (1, 1) for w in ("straße", "straße", "Àb", "ab")] + [(None, "abc"), (4, "q" * 100_000)]
    assert sorted(words, key=str) == sorted(want, key=str)
    counts = variants.word_counts(variants.word_runs(docs), 2, 2)
    assert {tuple(r) for r in counts.collect()} == {("straße", 4), ("Àb", 2), ("ab", 2)}


def test_lost_letters(spark):
    runs = spark.createDataFrame([(i, f"wörd{chr(97 + i % 26)}x") for i in range(60)] + [(None, "abcdef")], "id long, word string")
    got = Counter(tuple(r) for r in variants.drop_letters(runs, 3).select("id", "word").collect())
    want = Counter()
    for i, w in [tuple(r) for r in runs.collect()]:
        h = zlib.crc32(f"{i}:{w}".encode())
        want[(i, w if i is None or h % 3 else w[: h % len(w)] + w[h % len(w) + 1 :])] += 1
    assert got == want and any(len(w) == 5 for _, w in got)


def test_other_words_and_no_words(spark):
    assert found(variants.variant_groups(frame(spark, {"ab": 5, "a-b": 1, "": 2, "Ab": 3}))) == {("ab", None, "ab", 5, 0, None)}
    assert found(variants.variant_groups(frame(spark, {"ab": 1}).limit(0))) == set()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variant_report(empty).count() == 0


def test_report_on_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    import re

    counts: Counter = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = plain.fold(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    want = groups({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    docs = small_batches(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(variants.variant_report(docs)) == want
