"""Words and hashes of many texts at once, as NumPy arrays over one byte buffer. Runs inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def _bytes_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BASE, BASE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
BYTE_VALUES = _bytes_table()
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the process and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, CHUNK_BYTES + 1), base, U64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array and each text's offsets in it. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, most: int = CHUNK_BYTES):
    """(first row, one past the last, bytes, offsets): runs of rows of about `most` bytes, or one longer text. Every row once."""
    data, at = buffer_of(texts)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, stop, data[at[row]:at[stop]], at[row:stop + 1] - at[row]
        row = stop


class Prefix:
    """Hashes of any substrings from running sums: equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * powers(BASE_INVERSE, len(self.sums))[starts]
            return mix(raw + (ends - starts).astype(U64) * U64(0xD1342543DE82EF95))

    def fixed(self, length: int) -> np.ndarray:
        """Of the substring of one length at every position."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:-length]) * powers(BASE_INVERSE, n))


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of every text; a word never crosses two texts."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~breaks[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    inner = at[(at > 0) & (at < len(data))]
    before[inner] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def shingles(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words of one text, from word hashes in order."""
    count = len(word) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        value = np.zeros(count, U64)
        for i in range(n):
            value = value * U64(BASE) + word[i:i + count]
    same = row[:count] == row[n - 1:]
    return mix(value[same]), row[:count][same]


def per_row(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n_rows)


def equal_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins, in arrays sorted together."""
    first = np.ones(len(sorted_columns[0]), bool)
    if len(first) > 1:
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return first
