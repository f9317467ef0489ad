"""Word and shingle hashes of many texts at once, with array operations only."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` or more; the longest asked for are kept."""
    if n > max(_powers, default=0):
        _powers.clear()
        _powers[n] = np.cumprod(np.full(n, BASE, np.uint64)), np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
    return next(iter(_powers.values()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word (run of characters other than space and \\t\\n\\v\\f\\r), A-Z as a-z, in order."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([b"", *encoded, b""]).translate(LOWER), np.uint8)
    space = IS_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    h = mix((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([1, *(len(e) + 1 for e in encoded)])[:-1] if encoded else np.zeros(0, np.int64)
    return np.searchsorted(first, starts, side="right") - 1, h


def shingle_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``n`` words; a text of 1 to ``n - 1`` words has one, of all its words."""
    doc, w = word_hashes(texts)
    if not len(doc):
        return doc, w
    h = w
    for k in range(1, n):
        h = mix(h[: len(w) - k] * np.uint64(0xD6E8FEB86659FD93) + w[k:]) if len(w) > k else h[:0]
    whole = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
    counts = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < n))
    starts = np.cumsum(counts) - counts
    own = np.empty(len(short), np.uint64)
    for j, d in enumerate(short):
        x = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for v in w[starts[d] : starts[d] + counts[d]]:
                x = mix(np.array([x * np.uint64(0xD6E8FEB86659FD93) + v + np.uint64(1)]))[0]
        own[j] = x
    return np.concatenate([doc[: len(h)][whole], short]), np.concatenate([h[whole], own])


def distinct_sorted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs sorted by text number, then hash, each once."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]
