"""Word and shingle hashes of whole texts, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once (arrays that fit a core's cache); a longer run without a separator is
#: hashed as one block.
BLOCK = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Words:
    """Cuts texts into words: runs of bytes outside ``separators``, A-Z lower-cased.

    Separators are ASCII, so cutting UTF-8 bytes equals cutting code points. Byte
    0x20 must be a separator; it stands between two texts of a batch.
    """

    def __init__(self, separators: bytes):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        fold = np.arange(256)
        fold[65:91] += 32
        self.values = _BYTES[fold]
        self.inside_folded = self.inside[fold]
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, BLOCK + 1024)
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            for name, base in (("powers", _BASE), ("inverses", inverse)):
                p = np.full(n, base)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def _block(self, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, np.uint8)
        n = len(b)
        if not n:
            return np.zeros((3, 0), np.uint64)
        self._grow(n + 1)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = self.inside_folded[b]
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[b] * self.powers[:n], out=total[1:])
        h = (total[end] - total[start]) * self.inverses[start]
        return np.stack([mix(h + (end - start).astype(np.uint64)), start.astype(np.uint64), end.astype(np.uint64)])

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text number and running number in its text of every word, texts in order."""
        hashes, numbers = [], []
        i = 0
        while i < len(texts):
            if len(texts[i]) > BLOCK:
                for piece in self._pieces(texts[i]):
                    h = self._block(piece)[0]
                    hashes.append(h)
                    numbers.append(np.full(len(h), i))
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) <= BLOCK:
                size += len(texts[j]) + 1
                j += 1
            h, start, _ = self._block(b" ".join(texts[i:j]))
            begins = np.cumsum([0] + [len(t) + 1 for t in texts[i : j - 1]])
            hashes.append(h)
            numbers.append(i + np.searchsorted(begins, start.astype(np.int64), "right") - 1)
            i = j
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, number = np.concatenate(hashes), np.concatenate(numbers)
        first = np.searchsorted(number, np.arange(len(texts)))
        return h, number, np.arange(len(h)) - first[number]

    def _pieces(self, text: bytes):
        """A long text cut after separators."""
        at = 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                view = np.frombuffer(text, np.uint8, len(text) - end, end)
                for k in range(0, len(view), BLOCK):
                    stop = np.flatnonzero(~self.inside_folded[view[k : k + BLOCK]])
                    if len(stop):
                        end += k + int(stop[0])
                        break
                else:
                    end = len(text)
            yield text[at:end]
            at = end

    def shingles(self, texts: list[bytes], n: int) -> list[np.ndarray]:
        """Sorted distinct hashes of every text's n-word shingles; fewer words are one shingle."""
        h, number, _ = self.cut(texts)
        first = np.searchsorted(number, np.arange(len(texts) + 1))
        whole = chain(h, n)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(whole[a : b - n + 1]))
            elif b > a:
                out.append(chain(h[a:b], b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` neighbours, order and ``n`` taken into account."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix(out * _BASE + h[k : k + size])
    return out


def has_bit(bits: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Which values are in a bit set of ``2 ** size`` bits."""
    cell = values & np.uint64(2**size - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def utf8(values) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [v or b"" for v in values.cast("binary").to_pylist()]
