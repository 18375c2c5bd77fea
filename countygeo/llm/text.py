"""Arrow and numpy helpers that walk whole texts inside Spark tasks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Text bytes worked on at once in a task; one longer text is a block of its own.
BLOCK_BYTES = 1_000_000
# Odd base of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _table(word: np.ndarray) -> np.ndarray:
    """Hashed value of each byte, ASCII letters in lower case; 0 outside words."""
    byte = np.arange(256, dtype=np.uint64)
    upper = (byte >= 65) & (byte <= 90)
    return np.where(word, np.where(upper, byte + 32, byte) + 1, 0).astype(np.uint64)


_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128)
#: Letters, digits and everything outside ASCII.
ALNUM = _table(_LETTER | (_BYTE >= 48) & (_BYTE <= 57))
#: Letters and everything outside ASCII.
LETTERS = _table(_LETTER)
#: Everything but ASCII white space.
VISIBLE = _table(~np.isin(_BYTE, [9, 10, 11, 12, 13, 32]))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def geometric(ratio: int) -> np.ndarray:
        out = np.full(n, ratio, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return geometric(BASE), geometric(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over the whole range; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold ``limit`` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the row offsets into them; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return body[bounds[0]:bounds[-1]], bounds - bounds[0]


def byte_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Running sums from which ``spans_hash`` takes the hash of any span of bytes."""
    power, _ = _powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * power[:len(data)], out=total[1:])
    return total


def spans_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever the span stands."""
    _, inverse = _powers(1 << max(16, int(len(total) - 1).bit_length()))
    return mix((total[end] - total[start]) * inverse[start])


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, row) of each maximal run of word bytes inside a row."""
    value = table[data]
    inside = value != 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashed = spans_hash(byte_sums(data, table), start, end)
    row = np.searchsorted(bounds, start, side="right") - 1
    return hashed, start, end, row


def code_points(data: np.ndarray, bounds: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions as code point positions inside their rows."""
    count = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    return count[at] - count[bounds[row]]


def segment_sum(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of ``n`` rows."""
    return np.bincount(row, weights=values, minlength=n)


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one after the other."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - first, length)


def long_list(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """List column from concatenated values and the size of each list."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind or pa.int64()))


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` do not use, in any case of letters."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
