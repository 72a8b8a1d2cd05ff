"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes: vectors are turned by several learned rotations (iterative quantisation
on a bounded sample) and each coordinate's sign is a bit.  The index is dealt
out in shards by a hash of the id, so copies of one vector spread evenly.  In a
shard the code is split into 8-bit substrings, each with its own table from
value to rows.  Codes tell angles only, so candidates are ranked by the inner
product they promise: the vector's length times the cosine of the angle its
distance in bits stands for.  A query probes values at growing distance from its
own: after all values within s per substring are read, every code within
``substrings * (s + 1) - 1`` bits has been retrieved (pigeonhole), so probing
stops when enough candidates promise more than the longest vector could at any
larger distance.  They are then reranked by inner products of the original
vectors in double precision, and the shards' best lists are merged.

Defined cases: vectors that are null, empty, all zero or hold null or
non-finite components take no part; only vectors of equal length are compared;
rows with a null id take no part; rows that repeat an id are candidates each,
but not for a query of that id; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROTATIONS = 4
SAMPLE = 20_000
SHARD_ROWS = 8192
QUERY_ROWS = 1024
#: Candidates reranked per query and shard.
RERANK = 256
#: Probe distances that go through the tables bucket by bucket; then the codes are read whole.
LISTED = 2
#: Promises closer than this, as a share of the largest length, are ties.
TIE = 1e-6
RESULT = "query_id long, vec_id long, score double"
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))
_NEAR = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
#: ``_RINGS[s][v]`` are the values s bits from v.
_RINGS = [np.stack([np.flatnonzero(row == s) for row in _NEAR]) for s in range(LISTED)]


def random_rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 15) -> np.ndarray:
    """Turn the axes so that signs lose least (alternating codes and Procrustes)."""
    turn = random_rotation(sample.shape[1], seed)
    for _ in range(rounds if len(sample) >= 2 * sample.shape[1] else 0):
        u, _, v = np.linalg.svd(np.where(sample @ turn >= 0, 1.0, -1.0).T @ sample)
        turn = (u @ v).T
    return turn


def directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn_codes(sample: np.ndarray, rotations: int = ROTATIONS) -> np.ndarray:
    return np.concatenate([learn_rotation(sample, seed) for seed in range(rotations)], axis=1)


def encode(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes, one substring each."""
    return np.packbits(vectors @ turn >= 0, axis=1)


@dataclass
class Shard:
    """For each substring j, rows of value v are ``order[j, offset[j, v]:offset[j, v + 1]]``.

    ``words`` holds the codes a second time, 64 bits to a word and word by word,
    so distances are bit counts over whole columns.
    """

    words: np.ndarray
    lengths: np.ndarray
    order: np.ndarray
    offset: np.ndarray

    @classmethod
    def build(cls, codes: np.ndarray, lengths: np.ndarray | None = None) -> Shard:
        order = np.stack([np.argsort(c, kind="stable") for c in codes.T])
        offset = np.stack([np.concatenate([[0], np.cumsum(np.bincount(c, minlength=256))]) for c in codes.T])
        return cls(np.ascontiguousarray(as_words(codes).T), np.ones(len(codes)) if lengths is None else lengths, order, offset)

    def probe(self, code: np.ndarray, s: int, seen: np.ndarray) -> None:
        """Mark the rows of all buckets whose value is s bits from the code's, in any substring."""
        part, value = np.arange(len(code))[:, None], _RINGS[s][code]
        low, high = self.offset[part, value].ravel(), self.offset[part, value + 1].ravel()
        size = high - low
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        seen[self.order[np.repeat(np.repeat(part[:, 0], value.shape[1]), size), place]] = True

    def distances(self, word: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Bits in which the codes of the rows (all, if none are given) differ from one code, given as words."""
        return np.bitwise_count((self.words if rows is None else self.words.take(rows, axis=1)) ^ word).sum(0, dtype=np.int64)

    def nearest(self, code: np.ndarray, enough: int) -> np.ndarray:
        """Rows of at least the ``enough`` largest promises: all down to some promise."""
        n, parts = self.order.shape[1], len(self.order)
        if n <= enough:
            return np.arange(n)
        cosine, longest = np.cos(np.pi * np.arange(8 * parts + 1) / (8 * parts)), self.lengths.max()
        seen, word = np.zeros(n, bool), as_words(code[None]).T
        for s in range(LISTED):
            self.probe(code, s, seen)
            rows = np.flatnonzero(seen)
            if len(rows) < enough:
                continue
            promise = self.lengths[rows] * cosine[self.distances(word, rows)]
            limit = np.partition(promise, len(rows) - enough)[len(rows) - enough] - TIE * longest
            beyond = cosine[min(parts * (s + 1), 8 * parts)]
            if len(rows) == n or limit > beyond * (longest if beyond > 0 else self.lengths.min()):
                return rows[promise >= limit]
        promise = self.lengths * cosine[self.distances(word)]
        return np.flatnonzero(promise >= np.partition(promise, n - enough)[n - enough] - TIE * longest)


def as_words(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, filled up with zeros."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in component order, so copies score alike."""
    return column_scores(query, np.ascontiguousarray(vectors.T))


def column_scores(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The same of vectors given component by component: whole columns are added one after another."""
    return np.add.reduce(columns * query[:, None], axis=0)


def search_shard(query_ids, queries, vec_ids, vectors, turn, k, enough) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best candidates of one shard for each query."""
    shard = Shard.build(encode(vectors, turn), np.linalg.norm(vectors / np.abs(vectors).max(), axis=1))
    columns = np.ascontiguousarray(vectors.T)
    out = []
    for qid, query, code in zip(query_ids, queries, encode(queries, turn)):
        rows = shard.nearest(code, min(max(enough, 4 * k), len(vectors)))
        rows = rows[vec_ids[rows] != qid]
        scores, ids = column_scores(query, columns.take(rows, axis=1)), vec_ids[rows]
        best = np.lexsort((ids, -scores))[:k]
        out.append((np.full(len(best), qid), ids[best], scores[best]))
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """Ids and vectors (as doubles) that can take part."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE, enough: int = RERANK) -> DataFrame:
    """For each id divisible by ``every``, its k nearest other rows by inner product.

    A cell of work is one shard of the index and one block of queries; index
    rows go once to each block of queries, queries once to each shard.  Both
    are cut by counts, so no cell grows with the tables.
    """
    rows = usable(embeddings).withColumn("dim", F.size("v"))
    wanted = F.pmod("vec_id", F.lit(every)) == 0
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("dim").agg(F.count("*"), F.count(F.when(wanted, 1))).collect()}
    turns = {}
    for dim, (n, _) in sizes.items():
        space = 1 << 30
        picked = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(space)) < min(space, space * sample // n)))
        learned = picked.select("v").toPandas()["v"]
        turns[dim] = learn_codes(directions(np.stack(learned.to_numpy()))) if len(learned) else np.concatenate([random_rotation(dim, s) for s in range(ROTATIONS)], 1)
    turns = embeddings.sparkSession.sparkContext.broadcast(turns)

    def count(which: int, per: int):
        cases = F.lit(1)
        for dim, both in sizes.items():
            cases = F.when(F.col("dim") == dim, -(-both[which] // per)).otherwise(cases)
        return F.greatest(cases, F.lit(1))

    shards, blocks = count(0, SHARD_ROWS), count(1, QUERY_ROWS)
    place = lambda of: F.pmod(F.xxhash64("vec_id", F.lit(7)), of)
    every_one = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1))
    index = rows.select("dim", place(shards).alias("shard"), every_one(blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = rows.where(wanted).select("dim", every_one(shards).alias("shard"), place(blocks).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")

    def cell(key, found):
        frame = found.select(["asks", "vec_id"]).to_pandas()
        column = found["v"].combine_chunks()
        flat = np.asarray(column.flatten()).reshape(len(frame), -1)
        asks, ids = frame["asks"].to_numpy(bool), frame["vec_id"].to_numpy(np.int64)
        if not asks.any() or asks.all():
            best = []
        else:
            best = search_shard(ids[asks], flat[asks], ids[~asks], flat[~asks], turns.value[key[0].as_py()], k, enough)
        columns = [np.concatenate(c) for c in zip(*best)] if best else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    local = index.unionByName(queries).groupBy("dim", "shard", "block").applyInArrow(cell, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
