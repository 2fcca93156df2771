"""Words of whole texts as numbers: one pass over the bytes of an Arrow column.

A word is a run of ``[^\\x20\\x09-\\x0D]``, compared byte for byte.  Texts are taken in
slices of half a megabyte, so memory follows the longest text and not the batch.
A word is hashed eight bytes at a time, each block mixed with what came before; long words
are hashed one by one.  Hashes of word sequences are polynomials over prefix sums of these:
any run of words is hashed in constant time from two prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
# Odd multipliers that are 3 modulo 8, so that differences of powers keep few factors of two.
BASES = (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD3)
LONG_WORD = 64
_U64 = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (splitmix64)."""
    x = x + _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) and their inverses modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, _U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """H with H[j] - H[i] the hash of values[i:j], shifted by base**i."""
    sums = np.zeros(len(values) + 1, _U64)
    np.cumsum(values * powers(base, len(values))[0], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the runs [start, end) of one prefix table."""
    inverse = powers(base, len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U64))


@dataclass
class Words:
    """Words of some consecutive texts.  ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray  # bytes of all the texts
    start: np.ndarray  # byte where each word starts
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; other seeds give independent ones."""
        size = self.end - self.start
        out = mix(size.astype(_U64) + _U64(seed) * _U64(BASES[0]))
        held = np.zeros(len(self.data) + 8, np.uint8)
        held[: len(self.data)] = self.data
        blocks = np.ndarray(len(self.data) + 1, "<u8", held, strides=(1,))  # the eight bytes from each place on
        rest = np.flatnonzero(size <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            rest = rest[size[rest] > at]
            spare = np.maximum(0, 8 - (size[rest] - at)).astype(_U64)
            block = blocks[self.start[rest] + at] << (spare * _U64(8))
            out[rest] = mix(out[rest] ^ mix(block + _U64(at + 1)))
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), seed=seed)
        return out


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start_of = ~space
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    edges = offsets[offsets < len(data)]
    before[edges] = True
    edges = offsets[offsets > 0]
    after[edges - 1] = True
    start = np.flatnonzero(start_of & before)
    end = np.flatnonzero(start_of & after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets, side="left"))


def binary(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset binary; null stays null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary())


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a text column; null has no bytes."""
    column = binary(column).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of texts of about ``limit`` bytes, one text at least."""
    if not len(column):
        return
    data, offsets = raw(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(offsets) - 1)
        yield at, to, split_words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts, the last column, take about ``limit`` bytes."""
    _, offsets = raw(batch.column(batch.num_columns - 1))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to
