"""Vectorised text kernels: whole Arrow batches of texts as one byte array, words and hashes of them.

Hashes are 64-bit. A word's hash is a polynomial in its bytes with a fixed odd base, mixed; windows of words
combine word hashes with fixed odd multipliers and are mixed again. They depend on the bytes alone, so every
task of every job computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = [(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) | 1 for i in range(64)]

#: Maps each byte to itself, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no white space: [^\x20\x09-\x0D].
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and all non-ASCII bytes of lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, kept between calls."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 20), base, U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Block:
    """Some rows of an Arrow batch: ``data`` holds their texts' bytes, row i from offsets[i] to offsets[i + 1]."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.data, self.offsets = batch, data, offsets
        self.rows = len(offsets) - 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def prefix(self) -> np.ndarray:
        """Prefix sums that give any span's polynomial hash."""
        p, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * p[:-1], out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverse = powers(len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = 1 << 20, rows: int = 1 << 16) -> Iterator[Block]:
    """Cut a batch into blocks of about ``limit`` bytes of text and ``rows`` rows at most; a text is never cut. A null is empty."""
    array = text_array(batch.column(batch.schema.get_field_index(text)))
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = min(first + rows, max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1))
        part = batch.slice(first, last - first)
        yield Block(part, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(block: Block, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and word counts by row of the maximal runs of word bytes; no word crosses two rows."""
    if lower:
        block.data = LOWER[block.data]
    inside = np.zeros(len(block.data) + 2, bool)
    inside[1:-1] = is_word[block.data]
    cut = np.zeros(len(block.data) + 1, bool)
    cut[block.offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    counts = np.diff(np.searchsorted(starts, block.offsets))
    return starts, ends, counts


def word_hashes(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return block.span_hash(block.prefix(), starts, ends)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of ``size`` consecutive words, by its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(size))
    for i in range(size):
        total += mix(hashes[i : i + n] + U(i)) * U(_MULTIPLIERS[i])
    return mix(total)


def within(counts: np.ndarray, size: int) -> np.ndarray:
    """Marks the words from which ``size`` words of the same row follow, themselves included."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return left >= size


def output(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    if isinstance(got, pa.ChunkedArray):
        got = pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)
    return got
