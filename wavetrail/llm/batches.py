"""numpy helpers over Arrow text columns: bytes, words, window hashes, sliding minima.

Everything here works on one Arrow batch inside a task. Hashes are polynomial sums modulo 2**64 over randomised symbols, taken
from running totals, so a window of any length costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text whose arrays are held at once (a longer text is taken alone); they take some 50 times as much.
CHUNK_BYTES = 1 << 18
#: Bytes of text that are handed on at once.
SLICE_BYTES = 2 << 20
#: \x20 and \x09-\x0D separate words.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random 64-bit symbol for each byte.
SYMBOLS = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=U64)


class Totals:
    """Running totals of symbol * BASE**position; gives the hash of any span, the same wherever the span lies."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * _powers(BASE, n), dtype=U64, out=self.sums[1:])
        self.inverse = _powers(INVERSE, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the symbols in [start, end); the length counts too."""
        lengths = np.asarray(ends - starts).astype(U64)
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + lengths * U64(0xA24BAED4963EE407))

    def grams(self, width: int) -> np.ndarray:
        """Hashes of every run of `width` symbols."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + U64(width * 0xA24BAED4963EE407 % (1 << 64)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most `limit` bytes, or one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts that hold at most `limit` bytes in a column, or one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    for low, high in pieces(np.concatenate([[0], np.cumsum(lengths)]), limit):
        yield batch.slice(low, high - low)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[first[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Totals(SYMBOLS[data]).spans(starts, ends)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width]; len(values) - width + 1 results."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
