"""Vectorised word and shingle hashes of whole texts (numpy, for use inside tasks).

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum over the whole text, so there is no
Python call per word. Bytes go through a table of fixed random values first and sums through a finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_FOLDED = _VALUES[_LOWER]
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _runs(texts: pa.Array, budget: int):
    """(first row, last row + 1) of runs of rows whose bytes stay within ``budget``; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + budget, "right")))
        yield i, j
        i = j


def word_hashes(texts: pa.Array, budget: int = 1 << 20):
    """Yields (first row, hashes, offsets): 64-bit hashes of the words of the rows from ``first row`` on.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. ``offsets`` has the rows' ranges
    in ``hashes``. A null text has no words.
    """
    return ((i, h, at) for i, h, at, _ in word_places(texts, budget))


def word_places(texts: pa.Array, budget: int = 1 << 20):
    """What ``word_hashes`` yields, and the byte of its text where each word begins."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    for i, j in _runs(texts, budget):
        part = pa.concat_arrays([pc.fill_null(texts[i:j], b"")])
        at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        if not len(data):
            yield i, np.zeros(0, U), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
            continue
        space = _SPACE[data]
        starts_word = ~space
        starts_word[1:] &= space[:-1]
        ends_word = ~space
        ends_word[:-1] &= space[1:]
        # a text's first and last bytes end words too
        first, last = at[:-1][at[1:] > at[:-1]], at[1:][at[1:] > at[:-1]] - 1
        starts_word[first] = ~space[first]
        ends_word[last] = ~space[last]
        starts, ends = np.flatnonzero(starts_word), np.flatnonzero(ends_word) + 1
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.add.accumulate(_FOLDED[data] * power[: len(data)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
        ranges = np.searchsorted(starts, at)
        yield i, hashes, ranges, starts - np.repeat(at[:-1], np.diff(ranges))


def shingle_sets(texts: pa.Array, words: int):
    """Yields, for each row, the sorted distinct hashes of its runs of ``words`` words.

    A text of fewer words makes one run of all its words; a text without words, or a null, makes none.
    """
    for _, h, at in word_hashes(texts):
        n = len(h) - words + 1
        full = np.full(max(n, 0), U(words), U)
        for k in range(words if n > 0 else 0):
            full = (full ^ (full >> U(29))) * U(0xA0761D6478BD642F) + h[k : n + k] * U(0xBF58476D1CE4E5B9)
        full = mix(full)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(full[a : b - words + 1])
            elif b > a:
                x = np.full(1, U(b - a), U)
                for k in range(a, b):
                    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F) + h[k : k + 1] * U(0xBF58476D1CE4E5B9)
                yield mix(x)
            else:
                yield h[:0]


def set_key(tokens: np.ndarray) -> bytes:
    """A 128-bit key of a set of hashes."""
    with np.errstate(over="ignore"):
        return np.array([mix(tokens + U(1)).sum(dtype=U), mix(tokens ^ U(0xE7037ED1A0B428DB)).sum(dtype=U)], U).tobytes()
