"""Words of whole Arrow text batches as NumPy arrays.

Texts are looked at as UTF-8 bytes.  A word is a maximal run of bytes that are
not separators; words never cross rows.  Work goes in blocks of whole rows, so
memory follows the block (or one row, if that is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
SPAN = 1 << 18
U64 = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(SPAN + 1, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _IPOW = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (SplitMix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: true inside the given ranges, ends included."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, the latter after lower-casing.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """The bytes of some rows: row i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Word k is ``data[starts[k]:ends[k]]``; row i owns words ``bounds[i]:bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole rows of at most ``limit`` bytes, or one longer row."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows, row + 65536)
        yield Block(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def words(block: Block, separators: np.ndarray) -> Words:
    """Find the words of a block."""
    n = len(block.data)
    inside = ~separators[block.data]
    begins, finishes = inside.copy(), np.zeros(n + 1, dtype=bool)
    if n:
        begins[1:] &= ~inside[:-1]
        finishes[1:n] = inside[:-1] & ~inside[1:]
        finishes[n] = inside[-1]
        edges = block.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] = inside[edges]
        finishes[edges] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(finishes), np.searchsorted(starts, block.offsets))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """A 64-bit hash per range; equal symbols, equal hash, wherever they stand.

    Prefix sums of a polynomial with invertible base give all ranges in a
    stretch at once; a range longer than a stretch is summed up in parts.
    """
    out = np.zeros(len(starts), dtype=U64)
    k = 0
    while k < len(starts):
        low = int(starts[k])
        stop = int(np.searchsorted(ends, low + SPAN, "right"))
        if stop <= k:
            total, at = U64(0), low
            factor = U64(1)
            with np.errstate(over="ignore"):
                while at < ends[k]:
                    part = codes[data[at : min(at + SPAN, int(ends[k]))]]
                    total = total + factor * (part * _POW[: len(part)]).sum(dtype=U64)
                    factor, at = factor * _POW[SPAN], at + SPAN
            out[k], k = total, k + 1
            continue
        span = data[low : int(ends[stop - 1])]
        sums = np.zeros(len(span) + 1, dtype=U64)
        np.cumsum(codes[span] * _POW[: len(span)], dtype=U64, out=sums[1:])
        s, e = starts[k:stop] - low, ends[k:stop] - low
        out[k:stop] = (sums[e] - sums[s]) * _IPOW[s]
        k = stop
    return mix(out + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def folded(block: Block, table: np.ndarray = LOWER) -> Block:
    """The block with every byte mapped through a table."""
    return Block(table[block.data], block.offsets, block.first_row)


def per_row_sums(values: np.ndarray, found: Words) -> np.ndarray:
    """Sum of a value per word over each row, always added in word order."""
    return np.bincount(found.rows, weights=values, minlength=len(found.bounds) - 1)


def record_batch(columns: dict[str, pa.Array], schema: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)) if schema is None else pa.RecordBatch.from_arrays(list(columns.values()), schema=schema)
