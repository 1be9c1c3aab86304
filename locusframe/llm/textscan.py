"""Words, lines and shingles of many texts at once, as numpy arrays of hashes.

The functions work on slices of an Arrow string column: its UTF-8 bytes lie in one buffer,
so words of all its texts are found and hashed by whole-array operations. A slice holds
about ``SLICE_BYTES`` bytes (or one longer text), which bounds the memory of a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, _U)
_inverse_powers = np.ones(1, _U)

#: Bytes of a word by white space: all but \x20 and \x09-\x0D.
RAW_WORD = np.ones(256, bool)
RAW_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of a word for comparing texts: ASCII letters and digits, and all bytes of non-ASCII characters.
PLAIN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class Slice(NamedTuple):
    """Consecutive texts: number of the first, their bytes, and bounds (one more than texts)."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of a slice in order: text number in the slice, first byte, byte after the last, hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices; nulls count as empty texts."""
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + budget, "right")) - 1)
        last = min(last, n)
        yield Slice(first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _prepare(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept between calls up to one slice's size."""
    global _powers, _inverse_powers
    if len(_powers) >= n:
        return _powers[:n], _inverse_powers[:n]
    size = max(n, SLICE_BYTES + 1)
    factor = np.full(size, _BASE)
    factor[0] = 1
    powers = np.multiply.accumulate(factor)
    factor[1:] = _BASE_INVERSE
    inverse = np.multiply.accumulate(factor)
    if size <= 4 * SLICE_BYTES:
        _powers, _inverse_powers = powers, inverse
    return powers[:n], inverse[:n]


class Hasher:
    """Hashes of any byte ranges of one buffer, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _prepare(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes start to end (exclusive); equal bytes have equal hashes."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def ranges(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that don't cross a text's bounds: text number, start and end."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    filled = bounds[:-1] < bounds[1:]
    before[bounds[:-1][filled]] = False
    after[bounds[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(bounds, start, "right") - 1, start, end


def words(part: Slice, plain: bool) -> Words:
    """Words of a slice. plain: lower-cased ASCII, without punctuation; else by white space, as they are."""
    data = LOWER[part.data] if plain else part.data
    text, start, end = ranges((PLAIN_WORD if plain else RAW_WORD)[data], part.bounds)
    return Words(text, start, end, Hasher(data).of(start, end) if len(start) else np.zeros(0, _U))


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` consecutive words of one text, and its first word's number."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * _BASE + hashes[k : k + n]
    first = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix(total[first]), first


def shingle_sets(part: Slice, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word windows.

    A text with fewer words than ``size``, but at least one, has one shingle of all its words;
    a text without words has none.
    """
    found = words(part, plain=True)
    count = np.bincount(found.text, minlength=len(part.bounds) - 1)
    hashes, first = windows(found.hash, found.text, size)
    owner = found.text[first]
    edges = np.searchsorted(owner, np.arange(len(count) + 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    sets = []
    for i, n in enumerate(count):
        if 0 < n < size:
            total = found.hash[begin[i] : begin[i] + 1]
            for k in range(1, n):
                total = total * _BASE + found.hash[begin[i] + k]
            sets.append(mix(total + _U(n)))
        else:
            sets.append(np.unique(hashes[edges[i] : edges[i + 1]]))
    return sets
