"""Hashes of words and shingles of whole texts, by numpy over the buffers of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21  # bytes of text that are hashed at once; a longer text is a slice of its own
U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, dtype=U)  # a random value for each byte
STEP = U(0x9E3779B97F4A7C15)
FOLD = U(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort is much faster than numpy's own hashing unique."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most ``most`` bytes of text, or one row; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, lowered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, A-Z lower-cased if so asked, and the number of words before each row and after the
    last."""
    data = LOWER[data] if lowered else data
    ink = np.concatenate(([False], ~SPACE[data], [False]))
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True  # a row begins here
    starts = np.flatnonzero(ink[1:] & (~ink[:-1] | new))
    ends = np.flatnonzero(ink[:-1] & (~ink[1:] | new))
    power = np.full(len(data) + 1, STEP, U)
    back = np.full(len(data) + 1, U(inverse(int(STEP))), U)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.concatenate((np.zeros(1, U), np.cumsum(BYTE[data] * power[:-1], dtype=U)))
    hashes = mixed((total[ends] - total[starts]) * back[starts])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of one text's shingles; with fewer words the whole sequence is one."""
    if not len(words):
        return words
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, U(width), U)
    for k in range(width):
        out = out * FOLD + words[k : len(words) - width + 1 + k]
    return distinct(mixed(out))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The set of each row, in order."""
    for _, data, offsets in slices(column):
        words, at = word_hashes(data, offsets)
        for i in range(len(at) - 1):
            yield shingle_hashes(words[at[i] : at[i + 1]], size)
