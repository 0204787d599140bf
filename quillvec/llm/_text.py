"""Byte-level text kernels shared by the text operators.

All word definitions used here separate words by ASCII bytes only, so a text can be cut
on its UTF-8 bytes: a byte of a longer character is never a separator.  That lets one
NumPy pass serve a whole Arrow batch instead of a Python loop over documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def separator_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes inside a word, given the inclusive ranges of separator bytes."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = separator_table((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z has been lower-cased.
ALNUM = separator_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, byte offsets from 0) of runs of rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    word = inside[data]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    if len(word):
        before[0] = False
    breaks = offsets[:-1]
    breaks = breaks[breaks < len(word)]
    joined = before.copy()
    before[breaks] = False
    starts = np.flatnonzero(word & ~before)
    ends_at = joined & ~word  # a separator after a word
    ends_at[breaks] |= joined[breaks]  # or the next document after a word
    ends = np.flatnonzero(ends_at)
    if len(word) and word[-1]:
        ends = np.append(ends, len(word))
    return starts, ends, np.searchsorted(starts, offsets)


_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_R, _R_INV)):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(_LOWER.astype(np.uint64) + np.uint64(1))  # lower-cases as it maps


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans with A-Z lower-cased; equal spans have equal hashes anywhere."""
    up, down = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes; element i covers words i to i + n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * _R + words[j : len(words) - n + 1 + j]
    return mix(out)


def per_document(firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n-grams over words of many documents: True where a gram lies in one document, and each document's count."""
    counts = np.diff(firsts)
    grams = np.maximum(counts - (n - 1), 0)
    total = int(firsts[-1])
    ok = np.ones(max(total - n + 1, 0), dtype=bool)
    for j in range(1, n):  # grams that begin j words before the end of a document reach into the next
        at = firsts[1:] - j
        at = at[(at >= firsts[:-1]) & (at < len(ok))]
        ok[at] = False
    return ok, grams


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
