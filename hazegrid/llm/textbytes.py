"""UTF-8 texts of an Arrow batch as flat byte arrays, and fingerprints of any stretch of them.

All helpers work on many texts at once: the texts lie behind one another in one byte array, ``offsets`` has
the borders. A fingerprint of bytes ``a .. b`` is a difference of prefix sums times a power of an odd base,
modulo 2^64, finished by a bit mixer; equal bytes give equal values wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd multipliers and the finishing steps of a 64-bit mixer.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SLICE_BYTES = 512 << 10


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that any part of them may serve as a hash."""
    values = values ^ (values >> np.uint64(30))
    values = values * MIX_1
    values = values ^ (values >> np.uint64(27))
    values = values * MIX_2
    return values ^ (values >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A random-looking 64-bit code for each byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[seed % 2]) + np.uint64(seed))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or those of its inverse."""
    known = _POWERS.get((base, inverse))
    if known is None or len(known) < n:
        factor = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, SLICE_BYTES // 8), factor, dtype=np.uint64)
        steps[0] = 1
        known = _POWERS[base, inverse] = np.multiply.accumulate(steps)
    return known[:n]


class Prefix:
    """Fingerprints of stretches of one byte array."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.base = BASES[seed % 2]
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_codes(seed)[data] * powers(self.base, n), out=self.sums[1:])
        self.back = powers(self.base, n + 1, inverse=True)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end) + (end - start).astype(np.uint64))


def batch_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string column; a null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (one row at least), to bound the memory of array work."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def byte_classes(pattern: bytes) -> np.ndarray:
    """Table of the 256 byte values: true where the value is in ``pattern``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(pattern, dtype=np.uint8)] = True
    return table


# Bytes that no word holds, for the two ways of cutting words.
SPACES = b"\t\n\x0b\x0c\r "
NO_WORD = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes not in ``breaks``), and the first word of every row."""
    inside = ~breaks[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def sequence_hash(word: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` neighbours."""
    n = len(word) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, length, dtype=np.uint64)
    for step in range(length):
        total = total * np.uint64(BASES[1]) + word[step : step + n]
    return mixed(total)


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprint of every word; the words are worked off in stretches, so long rows need little memory."""
    out = np.empty(len(start), dtype=np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(start, start[first] + SLICE_BYTES // 4)))
        low = start[first]
        prefix = Prefix(data[low : end[last - 1]], seed)
        out[first:last] = prefix(start[first:last] - low, end[first:last] - low)
        first = last
    return out
