"""NumPy kernels over Arrow string columns: words, shingle sets, character n-grams.

All of them work on the UTF-8 bytes of whole batches. Separators are ASCII, so splitting bytes
splits characters rightly. Hashes are 64-bit; two different shingles share one with a chance of
about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once (a single longer text is one piece), which bounds temporaries.
PIECE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.RandomState(20240229).randint(0, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), bijective."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes each, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each row the index of its first word (one entry more than rows)."""
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SEPARATOR[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.cumsum(first) - 1
    at[: starts[0]] = 0
    place = np.arange(len(buf)) - starts[at]
    place[~inside] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    value = _BYTE[_LOWER[buf]] * powers[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its ``k``-word shingles.

    A-Z are lower-cased. A text of fewer than ``k`` words gives its whole word sequence as one
    shingle; a text without words, or null, gives an empty array.
    """
    buf, offsets = utf8(column)
    for a, b in pieces(offsets):
        part = offsets[a : b + 1]
        words, first = word_hashes(buf[part[0] : part[-1]], part - part[0])
        count = max(0, len(words) - k + 1)
        grams = np.zeros(count, np.uint64)
        for j in range(k):
            grams = grams * _STEP + words[j : j + count]
        grams = mix(grams)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                short = hi - lo
                for w in words[lo:hi]:
                    short = (short * int(_STEP) + int(w)) % 2**64
                yield mix(np.array([short ^ 0xA5A5A5A5], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


#: Bytes that belong to words for subword features: letters, digits and all of non-ASCII UTF-8.
_SUBWORD = np.full(256, 32, dtype=np.uint32)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _SUBWORD[_b] = _b
_SUBWORD[65:91] = _SUBWORD[97:123]


def subword_features(buf: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every character n-gram and of every whole word, one pair of arrays for each kind.

    A word is a run of letters and digits; a space stands for its two edges, so that "<id" and
    "idi" differ. N-grams never cross a word's edge.
    """
    n = len(offsets) - 1
    total = len(buf) + 2 * n
    # every text gets a space before and after it
    lengths = np.diff(offsets)
    base = np.concatenate([[0], np.cumsum(lengths + 2)])
    text = np.full(total + max(sizes), 32, np.uint32)
    place = np.arange(len(buf)) + 2 * np.repeat(np.arange(n), lengths) + 1
    text[place] = _SUBWORD[buf]
    letter = text != 32
    row = np.repeat(np.arange(n), lengths + 2)
    h = np.zeros(total, np.uint32)
    whole = np.ones(total, bool)
    for size in range(1, max(sizes) + 1):
        h = h * np.uint32(0x01000193) + text[size - 1 : size - 1 + total] * np.uint32(0x9E3779B1)
        if size >= 3:
            whole &= letter[size - 2 : size - 2 + total]
        if size in sizes:
            ok = np.flatnonzero(whole & (base[row + 1] - np.arange(total) >= size))
            yield row[ok], _bucket(h[ok] + np.uint32(size), mask)
    letter = letter[:total]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first)
    if len(starts):
        at = np.cumsum(first) - 1
        at[: starts[0]] = 0
        rel = np.arange(total) - starts[at]
        rel[~letter] = 0
        powers = np.cumprod(np.full(int(rel.max()) + 1, 0x01000193, np.uint32), dtype=np.uint32)
        value = np.where(letter, text[:total] * np.uint32(0x9E3779B1) * powers[rel], 0).astype(np.uint32)
        yield row[starts], _bucket(np.add.reduceat(value, starts, dtype=np.uint32) + np.uint32(99), mask)


def _bucket(h: np.ndarray, mask: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    return (h & np.uint32(mask)).astype(np.int32)
