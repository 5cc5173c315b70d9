"""Vectorised byte-level text helpers shared by the Arrow-based operators.

Everything works on numpy views of Arrow buffers: no Python object is made
per word.  Work goes in slices of a few hundred kilobytes so that temporaries stay in
cache and memory is bounded whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters: ASCII letters, and every byte of a multi-byte character.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in ((0, _M), (1, _M_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.fill_null(column, b"" if pa.types.is_binary(column.type) else ""), pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of whole rows.

    A row longer than the limit makes a run of its own.
    """
    raw, offsets = buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of maximal runs where ``inside``; no run crosses a row."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.empty(n, dtype=bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(n, dtype=bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand."""
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` and the first word of each row (with an end mark)."""
    raw = LOWER[raw]
    starts, ends = spans(~SPACE[raw], offsets)
    return hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def shingles(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each row, sorted and distinct, with row bounds.

    A row of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    counts = np.diff(first)
    grams = np.zeros(len(word), dtype=np.uint64)
    for j in range(min(width, len(word))):
        grams[: len(word) - j] += mix(word[j:] + np.uint64(j + 1))
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(word)) - first[rows] if len(word) else np.zeros(0, dtype=np.int64)
    whole = at <= counts[rows] - width
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        seq = word[first[r] : first[r + 1]]
        grams[first[r]] = sum((int(mix(seq[j : j + 1] + np.uint64(j + 1))[0]) for j in range(len(seq))), len(seq)) % (1 << 64)
        whole[first[r]] = True
    rows, grams = rows[whole], mix(grams[whole])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    if len(rows):
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
        rows, grams = rows[new], grams[new]
    return grams, np.searchsorted(rows, np.arange(len(counts) + 1))
