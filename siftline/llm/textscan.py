"""Vectorised text scanning for Arrow batches: words, n-grams and rolling hashes in numpy.

Texts are joined to one array of code points, so the cost per character is a few array
operations, whatever the number of rows. Hashes are 64-bit and depend on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
TOP = np.uint64(MASK)
#: code points handled at once; one longer text makes one larger chunk
CHUNK = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _classes() -> np.ndarray:
    """1: letter or digit, 2: underscore, by code point of the first 0x20000 (beyond: letters)."""
    out = np.zeros(0x20000, np.uint8)
    out[[i for i in range(0x20000) if not 0xD800 <= i < 0xE000 and chr(i).isalnum()]] = 1
    out[ord("_")] = 2
    return out


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, wrapping at 64 bits."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", BASE_INV)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of values[start:end], independent of the place."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start])


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null as empty) of about ``limit`` code points, with the place of the first."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > limit:
            yield at, run
            at, size, run = i, 0, []
        run.append(t)
        size += len(t) + 1
    if run:
        yield at, run


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a 0, and the start of each text (plus the end)."""
    joined = "\0".join(texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return c, np.concatenate([[0], np.cumsum(n)])


def kinds(c: np.ndarray) -> np.ndarray:
    return np.where(c < 0x20000, _classes()[np.minimum(c, 0x1FFFF)], np.where(c < 0x40000, 1, 0)).astype(np.uint8)


class Words:
    """Words of a chunk of texts: ``hash``, ``start``, ``end`` (in the chunk) and, for text i,
    the slice ``at[i]:at[i + 1]``. A word is a maximal run of letters, digits and, where
    ``underscore``, underscores."""

    def __init__(self, texts: list[str], underscore: bool = True):
        c, begin = codes(texts)
        self.codes, self.begin = c, begin
        k = kinds(c)
        w = (k > 0) if underscore else (k == 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], w, [False]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = spans_hash(prefix(mix(c.astype(np.uint64) + np.uint64(1))), self.start, self.end)
        self.at = np.searchsorted(self.start, begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.at))


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of each n successive items of one document: (first positions, hashes)."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return first, spans_hash(prefix(hashes), first, first + n)


def occurrence(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the same value stood before in the same document."""
    if not len(values):
        return np.zeros(0, np.int64)
    key = mix(values ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    place = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out
