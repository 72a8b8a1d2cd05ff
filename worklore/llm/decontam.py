"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task cuts its documents into shards.  A shard's suffix array is built by
prefix doubling over word numbers; every suffix of every benchmark item is
looked up in it by binary search, one word deeper at a time, which gives the
longest verbatim match and all its places.  Suffixes that start with a word
pair no item has cannot match and are left out of the array.

Defined cases: null or empty texts have no words and are clean; items without
words match nothing; repeated documents are each reported; repeated item ids
count once; an empty benchmark leaves everything clean; other columns of the
tables are never looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from worklore.llm import textbytes as tb

WINDOW = 10
#: Characters of benchmark text per broadcast block; more items make more blocks.
BLOCK_CHARS = 16_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"
NO_ITEMS = hashlib.sha256(b"").hexdigest()


@dataclass
class Items:
    """Benchmark words as vocabulary numbers, item after item."""

    ids: list[str]
    vocabulary: np.ndarray
    words: np.ndarray
    item: np.ndarray
    left: np.ndarray
    need: np.ndarray
    pairs: np.ndarray
    shortest: int


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and words per row of a small text column."""
    found, counts = [], []
    for block in tb.blocks(column):
        block = tb.folded(block)
        w = tb.words(block, tb.NOT_ALNUM)
        found.append(tb.hash_words(block.data, w.starts, w.ends))
        counts.append(w.counts)
    return np.concatenate(found or [np.zeros(0, tb.U64)]), np.concatenate(counts or [np.zeros(0, np.int64)])


def item_block(rows: list[tuple[str, str | None]], window: int) -> Items | None:
    hashes, counts = _hashes(pa.array([t for _, t in rows], pa.string()))
    if not len(hashes):
        return None
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    item = np.repeat(np.arange(len(rows)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(hashes))
    left = ends - place
    size = counts[item]
    # A window starts where `need` is not 0; a short item is one window.
    need = np.where(size >= window, np.where(left >= window, window, 0), np.where(left == size, size, 0))
    inner = left > 1
    pairs = np.unique(numbers[:-1][inner[:-1]] * len(vocabulary) + numbers[1:][inner[:-1]])
    return Items([i for i, _ in rows], vocabulary, numbers, item, left, need, pairs, int(need[need > 0].min()))


def share_items(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW) -> list[Broadcast]:
    """Broadcast the items in blocks of bounded size."""
    blocks, rows, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        rows.append(("" if row[0] is None else str(row[0]), row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_CHARS:
            blocks.append(item_block(rows, window))
            rows, size = [], 0
    blocks.append(item_block(rows, window))
    return [spark.sparkContext.broadcast(b) for b in blocks if b is not None]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` sorted by what follows, over the first ``depth`` words at least."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step, n = 1, len(text)
    while step < depth and rank.max(initial=0) < n:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def _bound(text, order, deep, low, high, word, right):
    """First place in ``order[low:high]`` whose word at depth ``deep`` is (right: above) ``word``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.minimum(order[np.minimum(mid, len(order) - 1)] + deep, len(text) - 1)
        less = (text[at] <= word) if right else (text[at] < word)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is of."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size), owner


def match_shard(hashes: np.ndarray, rows: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows found in a shard: (word place, length, item) of each, and (row, length) of longest matches."""
    none = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    number = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    number = np.where(items.vocabulary[number] == hashes, number, -1)
    if items.shortest == 1:
        kept = number >= 0
    else:
        joined = (number[:-1] >= 0) & (number[1:] >= 0) & (rows[:-1] == rows[1:])
        joined[joined] = np.isin(number[:-1][joined] * len(items.vocabulary) + number[1:][joined], items.pairs)
        edge = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first + 1 >= items.shortest
        kept = np.zeros(len(hashes), bool)
        kept[_expand(first[long], last[long] + 1)[0]] = True
    at = np.flatnonzero(kept)
    if not len(at):
        return none
    # Stretches stand one after another; -1 ends each, so no match runs over.
    apart = np.concatenate([[False], (np.diff(at) > 1) | (np.diff(rows[at]) > 0)])
    slot = np.arange(len(at)) + np.cumsum(apart)
    text = np.full(slot[-1] + 2, -1, np.int64)
    text[slot] = number[at]
    place = np.full(len(text), -1, np.int64)
    place[slot] = at
    order = suffix_array(text, int(items.left.max()))
    query = np.flatnonzero((items.need > 0) & np.isin(items.words, text))
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(text), np.int64)
    windows, longest, deep = [], [], 0
    while len(query):
        word = items.words[query + deep]
        low, high = _bound(text, order, deep, low, high, word, False), _bound(text, order, deep, low, high, word, True)
        deep += 1
        found = low < high
        query, low, high = query[found], low[found], high[found]
        full = items.need[query] <= deep
        if full.any():
            spot, owner = _expand(low[full], high[full])
            spot, owner = place[order[spot]], query[full][owner]
            longest.append(np.stack([rows[spot], np.full(len(spot), deep)], 1))
            exact = items.need[owner] == deep
            windows.append(np.stack([spot[exact], np.full(exact.sum(), deep), items.item[owner[exact]]], 1))
        more = items.left[query] > deep
        query, low, high = query[more], low[more], high[more]
    if not windows:
        return none
    return np.concatenate(windows), np.concatenate(longest)


def scan_texts(column: pa.Array, shared: list[Broadcast]) -> dict[str, np.ndarray | list]:
    """The report columns (all but the id) for a batch of texts."""
    n = len(column)
    n_words, n_hit, n_items, longest = (np.zeros(n, np.int64) for _ in range(4))
    digests = [NO_ITEMS] * n
    for block in tb.blocks(column):
        block = tb.folded(block)
        w = tb.words(block, tb.NOT_ALNUM)
        rows, here = w.rows, slice(block.first_row, block.first_row + block.rows)
        n_words[here] = w.counts
        if not len(rows):
            continue
        hashes = tb.hash_words(block.data, w.starts, w.ends)
        edges, pairs = np.zeros(len(rows) + 1, np.int64), set()
        for items in (b.value for b in shared):
            windows, lengths = match_shard(hashes, rows, items)
            np.add.at(edges, windows[:, 0], 1)
            np.add.at(edges, windows[:, 0] + windows[:, 1], -1)
            pairs |= {(r, items.ids[i]) for r, i in np.unique(np.stack([rows[windows[:, 0]], windows[:, 2]], 1), axis=0).tolist()}
            np.maximum.at(longest, lengths[:, 0] + block.first_row, lengths[:, 1])
        n_hit[here] = np.bincount(rows, weights=np.cumsum(edges[:-1]) > 0, minlength=block.rows).astype(np.int64)
        names: dict[int, list[str]] = {}
        for r, item in pairs:
            names.setdefault(r + block.first_row, []).append(item)
        for r, found in names.items():
            n_items[r] = len(found)
            digests[r] = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return {"n_words": n_words, "n_hit": n_hit, "n_items": n_items, "items_sha256": digests, "contaminated": n_hit > 0, "longest_match": longest}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words inside benchmark windows, items met, longest match."""
    shared = share_items(docs.sparkSession, benchmark, window)

    def report(batches):
        for batch in batches:
            found = scan_texts(batch.column(1), shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in found.values())], names=["doc_id", *found])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(report, SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns as they are, without those that hold a benchmark window."""
    shared = share_items(docs.sparkSession, benchmark, window)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(~scan_texts(batch.column(at), shared)["contaminated"]))

    return docs.mapInArrow(keep, docs.schema)
