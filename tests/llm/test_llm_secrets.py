from __future__ import annotations

import random
import re
import time

from linehaul.llm import secrets
from linehaul.llm.stage import small_batches

PATTERNS = [
    (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 1, 6),
    ("AKIA[A-Z0-9]+", 0, 0, 20),
    ("[0-9a-f]{24,}", 0, 0, 24),
    ("[A-Za-z0-9+/_-]{20,}", 0, 0, 20),
]


def plain_spans(rows: list[tuple]) -> dict:
    """(id, text, owner) to {id: [(start, kind, stop)]}, by scanning each text."""
    found, owners = {}, {}
    for i, text, owner in rows:
        every = []
        for kind, (pattern, flags, group, least) in enumerate(PATTERNS):
            for m in re.finditer(pattern, text or "", flags):
                v = m.group(group)
                if len(v) >= least and (kind < 3 or all(re.search(c, v) for c in ("[0-9]", "[a-z]", "[A-Z]"))):
                    every.append((m.start(), kind, m.end(), v))
        base = [s for s in every if s[1] < 3]
        every = base + [s for s in every if s[1] == 3 and not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        found[i] = every
        for s in every:
            owners.setdefault(s[3], set()).add(owner)
    return {i: sorted(s[:3] for s in every if s[1] < 3 or len(owners[s[3]]) == 1) for i, every in found.items()}


def scanned(spark, rows):
    df = small_batches(spark).createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return {r.id: r.spans or [] for r in secrets.scan_secrets(df).collect()}


def test_random_texts_against_a_plain_scan(spark):
    rng = random.Random(8)
    parts = ["token=", "é ", "AKIA", "Ab1" * 7, "0123456789abcdef" * 2, "Zz9/" * 6, " ", "secret: ", "x", "AKIA" + "Q7" * 9, "password='Aa1Bb2Cc3Dd4Ee5Ff6Gg7'", "\n"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25))), rng.choice(["a", "b"])) for i in range(150)] + [(150, None, "a"), (151, "", None)]
    got = {i: [(s["start"], s["kind"], s["stop"]) for s in spans] for i, spans in scanned(spark, rows).items()}
    assert got == plain_spans(rows) and sum(s[1] == 3 for spans in got.values() for s in spans) > 5


def test_owners_decide_whatever_the_number_and_length(spark):
    own, shared, long = "Own1" * 6, "Both2" * 6, "Long3x" * 200
    rows = [(i, f"{own} text {i}", "a") for i in range(40)] + [(i, f"{own} text 0", "a") for i in range(40, 60)]
    rows += [(100, shared, "a"), (101, shared, "b"), (102, long, "c"), (103, long, None)]
    got = scanned(spark, rows + [(104, "More4" * 100, None)])
    assert all([(s.value, s.owners, s.live) for s in got[i]] == [(own, 1, True)] for i in range(60))
    # Copies of a text count as one repository.
    assert {s.repositories for i in range(60) for s in got[i]} == {40}
    assert got[100] == got[101] == got[102] == [] and [s.stop for s in got[104]] == [500]


def test_a_text_with_very_many_matches(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("0123456789abcdef", k=32)) if k % 2 else "Aa1" * 8 for k in range(16_000)]
    rows = [(1, " ".join(words), "a")]
    scanned(spark, rows[:0] + [(2, words[0], "a")])
    start = time.time()
    got = scanned(spark, rows)
    assert len(got[1]) == 16_000 and time.time() - start < 20
    at = 0
    for s, w in zip(got[1], words):
        assert (s.start, s.stop, s.value) == (at, at + len(w), w)
        at += len(w) + 1
