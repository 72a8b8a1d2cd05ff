"""Shingle sets of whole texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from worklore.llm import textbytes as tb

SIZE = 5
BLOCK_BYTES = 2 << 20
_PLACE = tb.mix(np.arange(101, 101 + SIZE, dtype=tb.U64))
_LENGTH = tb.mix(np.arange(201, 201 + SIZE, dtype=tb.U64))


def shingle_hashes(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct 5-word shingles, sorted by both; a shorter text is one shingle."""
    block = tb.folded(block)
    found = tb.words(block, tb.SPACES)
    if not len(found.starts):
        return np.zeros(0, np.int64), np.zeros(0, tb.U64)
    word = tb.hash_words(block.data, found.starts, found.ends)
    rows, counts = found.rows, found.counts
    n = len(word)
    padded = np.concatenate([word, np.zeros(SIZE, tb.U64)])
    left = np.repeat(found.bounds[1:], counts) - np.arange(n)
    total = np.zeros(n, tb.U64)
    for k in range(SIZE):
        total += np.where(left > k, padded[k : k + n] * _PLACE[k], tb.U64(0))
    first = found.bounds[rows]
    short = counts[rows] < SIZE
    starts = np.where(short, np.arange(n) == first, left >= SIZE)
    total += np.where(short, _LENGTH[np.minimum(counts[rows], SIZE - 1)], tb.U64(0))
    row, code = rows[starts], tb.mix(total[starts])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[fresh], code[fresh]


def sets_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row bounds, sorted distinct hashes) block by block."""
    for block in tb.blocks(column, BLOCK_BYTES):
        row, code = shingle_hashes(block)
        yield block.first_row, block.rows, np.searchsorted(row, np.arange(block.rows + 1)), code


def set_keys(bounds: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each row's set, as two signed 64-bit columns."""
    keys = []
    for salt in (0x51, 0xA7):
        sums = np.concatenate([np.zeros(1, tb.U64), np.cumsum(tb.mix(code ^ tb.U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), dtype=tb.U64)])
        keys.append(tb.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(tb.U64)).view(np.int64))
    return keys[0], keys[1]
