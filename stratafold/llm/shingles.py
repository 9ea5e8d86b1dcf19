"""Word shingles as 64-bit hashes, for many texts at once.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D, with A-Z in lower case.
A text's set has the hash of every ``WIDTH`` consecutive words; a text with fewer words
has its whole sequence as one shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, WIDTH + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    space: by byte whether it separates words; the space itself must.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    body = ~space[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], body.view(np.int8)))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = (np.arange(lengths.sum()) - np.repeat(first, lengths)).astype(np.uint64)
    # A sum of mixed (byte, place) values: unlike a polynomial modulo 2^64, no letters cancel one another.
    hashed = np.add.reduceat(mix(_BYTE[data[body]] + place * _BASE), first)
    bounds = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    return mix(hashed + lengths.astype(np.uint64) * _ODD[WIDTH]), counts


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, ascending within a text, and their number by text."""
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH if len(rolled) else 0):
        rolled += words[k : len(words) - WIDTH + 1 + k] * _ODD[k]
    rolled = mix(rolled)
    out, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n >= WIDTH:
            found = np.unique(rolled[at : at + n - WIDTH + 1])
        elif n:
            total = np.uint64(n)
            with np.errstate(over="ignore"):
                for k in range(n):
                    total = total + words[at + k] * _ODD[k]
                found = mix(np.array([total * _ODD[WIDTH + 1]], np.uint64))
        else:
            found = rolled[:0]
        at += n
        sizes[i] = len(found)
        out.append(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
