"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Features are word unigrams and bigrams and the same of word shapes (runs of
upper case, lower case, digits, other letters, and punctuation marks as they
are), plus a mark for a word that repeats the one before.  Every feature is
hashed into one weight array; a value is the feature's share of the document's
words.  Workers train on parts of the sample and their weights are averaged;
scoring is a sparse dot product per document.

Defined cases: a null, empty or wordless text has no features and gets the
bias's score; without labels of both classes every score is the share of
label 1 (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklore.llm import textbytes as tb
from worklore.llm.common import fold
from worklore.llm.labelled import labelled_texts

#: Bound of the training sample per class.
SAMPLE = 10_000
BITS = 18
SCALE = 30.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.05, 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = ord("U"), ord("l"), ord("0"), ord("h")


def _shapes(block: tb.Block, found: tb.Words) -> np.ndarray:
    """Hash of each word's run-compressed byte classes."""
    kinds = _CLASS[block.data]
    first = np.ones(len(kinds), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[found.starts] = True
    inside = np.zeros(len(kinds) + 1, np.int8)
    inside[found.starts], inside[found.ends] = 1, inside[found.ends] - 1
    kept = first & (np.cumsum(inside[:-1]) > 0)
    upto = np.concatenate([[0], np.cumsum(kept)])
    return tb.hash_words(kinds[kept], upto[found.starts], upto[found.ends])


def features(block: tb.Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature occurrence, and words per row."""
    found = tb.words(block, tb.SPACES)
    rows = found.rows
    word = tb.hash_words(tb.LOWER[block.data], found.starts, found.ends)
    shape = _shapes(block, found)
    joined = rows[1:] == rows[:-1]
    pair = lambda h, salt: tb.mix(h[:-1][joined] * tb.U64(3) + h[1:][joined] + tb.U64(salt))
    again = (word[1:] == word[:-1])[joined]
    second = rows[1:][joined]
    codes = [tb.mix(word + tb.U64(1)), pair(word, 2), tb.mix(shape + tb.U64(3)), pair(shape, 4), np.full(again.sum(), 12345, tb.U64)]
    places = [rows, second, rows, second, second[again]]
    buckets = (np.concatenate(codes) >> tb.U64(64 - bits)).astype(np.int64)
    return np.concatenate(places), buckets, found.counts


def train(texts: pa.Array, labels: np.ndarray, start: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """FTRL-proximal over the rows in shuffled order; the last weight is the bias."""
    size = 1 << BITS
    docs = []
    for block in tb.blocks(texts):
        rows, buckets, counts = features(block)
        order = np.argsort(rows, kind="stable")
        ends = np.searchsorted(rows[order], np.arange(block.rows + 1))
        for r in range(block.rows):
            ids, n = np.unique(buckets[order[ends[r] : ends[r + 1]]], return_counts=True)
            docs.append((np.append(ids, size), np.append(SCALE * n / max(1, counts[r]), 1.0)))
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    turn = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in turn.permutation(len(docs)).tolist():
            ids, x = docs[k]
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[ids] = ni + g * g
    return weights(z, n)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for block in tb.blocks(texts):
            rows, buckets, counts = features(block)
            dot = np.bincount(rows, weights=self.weights[buckets], minlength=block.rows) * SCALE / np.maximum(1, counts)
            out[block.first_row : block.first_row + block.rows] = 1 / (1 + np.exp(-np.clip(dot + self.bias, -35, 35)))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model:
    """Train on a bounded sample: about ``bound`` labelled rows per class."""
    rows = labelled_texts(docs, labels, label, bound)
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = np.clip(sum(y * c for y, c in counts.items()) / total if total else 0.5, 0.001, 0.999)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    workers = min(8, max(1, total // 2500))

    worker = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(workers))

    def work(key, found):
        found = found.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")]).combine_chunks()
        weights = train(found["text"].combine_chunks(), found["y"].to_numpy())
        used = np.flatnonzero(weights)
        return pa.table({"at": used, "w": weights[used] * found.num_rows})

    each = rows.withColumn("worker", worker).groupBy("worker").applyInArrow(work, "at long, w double")
    mean = each.groupBy("at").agg((F.sum("w") / total).alias("w")).toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[mean["at"].to_numpy()] = mean["w"].to_numpy()
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, parts: int = 5) -> DataFrame:
    """One row per document with its score; ``held_out`` marks the fold that was not learned from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def report(batches):
        for batch in batches:
            s = shared.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), parts) == 0).alias("held_out"), "text").mapInArrow(report, SCHEMA)
