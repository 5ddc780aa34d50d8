"""64-bit hashes of words, word prefixes and word shingles for whole batches of texts, without a Python loop over words.

A word's hash is a polynomial over its bytes, taken from one running sum over the batch. ``A-Z`` count as ``a-z``.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _byte_values() -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


BYTE_VALUES = _byte_values()
#: Space, and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII that is neither letter nor digit.
PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(128) if not chr(c).isalnum()]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """start, end: byte range of each word; first: index of each text's first word, with the number of words at its end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        n = len(data)
        self.data = data
        inside = ~separators[data] if n else np.zeros(0, bool)
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = offsets[:-1][offsets[:-1] < n]
            begins[edges] = inside[edges]
            last = offsets[1:][offsets[1:] > 0] - 1
            ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUES[data] * up[:n], out=self._sums[1:], dtype=U)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Of whole words, or of their first bytes."""
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        h = (self._sums[end] - self._sums[self.start]) * self._down[self.start]
        return mix(h + (end - self.start).astype(U))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes text by text, offsets): runs of k words, or all words of a shorter text as one."""
    h, first = words.hashes(), words.first
    m = len(h)
    rolled = np.zeros(max(0, m - k + 1), U)
    factor = U(0xC2B2AE3D27D4EB4F)
    for j in range(k):
        rolled = rolled * factor + h[j : m - k + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled + U(k))
    out, offsets = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            s = np.unique(rolled[a : b - k + 1])
        elif b > a:
            v = U(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    v = v * factor + x
                s = mix(np.array([v + U(b - a)], U))
        else:
            s = h[:0]
        out.append(s)
        offsets[i + 1] = offsets[i] + len(s)
    return (np.concatenate(out) if out else h[:0]), offsets
