"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near_components(rows: list[tuple], n: int, percent: int) -> dict:
    """(id, text) to {id: (set size, smallest reachable id)}."""
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", fold(text or "")) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and (s := len(sets[a] & sets[b])) and 100 * s >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {i: (len(s), least[i]) for i, s in sets.items()}


def line_dedup(rows: list[tuple], least: int = 10) -> dict:
    """(id, text) to {id: (lines, kept text)}."""
    key = lambda line: fold(line.strip(" \t\n\x0b\x0c\r"))
    lines = {i: (t or "").split("\n") for i, t in rows}
    holders: dict[str, set] = {}
    for i, ls in lines.items():
        for line in ls:
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    keep = lambda i, line: len(holders.get(key(line), ())) < 2 or min(holders[key(line)]) == i
    return {i: (len(ls), "\n".join(x for x in ls if keep(i, x))) for i, ls in lines.items()}


def benchmark_words(text: str | None) -> list[str]:
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or "")) if x]


def benchmark_hits(rows: list[tuple], items: list[tuple], size: int = 10) -> dict:
    """(id, text) and (item, text) to {id: (words, hit words, sorted items)}."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = benchmark_words(text)
        k = min(len(w), size)
        for x in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[x : x + k]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w, hit, found = benchmark_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for x in range(len(w) - k + 1):
                if tuple(w[x : x + k]) in windows:
                    hit |= set(range(x, x + k))
                    found |= windows[tuple(w[x : x + k])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def repeats(rows: list[tuple], length: int = 100) -> dict:
    """(id, text) to {id: (bytes, removed, spans, digest of the rest)}."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def unigram_tokens(pieces: dict[str, int], byte: int, word: str) -> int:
    """Tokens of the cheapest segmentation, by trying all."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * byte, best[end - 1][1] + size)]
        options += [
            (best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in pieces
        ]
        best.append(min(options))
    return best[-1][1]


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
