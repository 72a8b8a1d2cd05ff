"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors come in blocks of bounded size.  In a block the tree is grown with
shortest edges (Prim).  A candidate c is scored at the root; along an edge of
length e from parent to child its score moves by at most e times the norm of c,
so what is known at the parent (a score, or bounds) gives bounds at the child.
Only candidates whose bounds meet what the child looks for are scored there,
which makes their bounds exact again; the others go on with their bounds.

First pass, positives: a candidate of the anchor's label is scored if its upper
bound reaches the k-th best score so far.  Second pass, negatives: a candidate
of another label is scored if its bounds meet the span of the anchor's windows,
one window below each positive.  Both read the candidates where they lie, in
Arrow batches; only each task's best lists are shuffled.  Scores are integers,
so no rounding touches a rank or a window.

Defined cases: rows with a null id, a null label, a null or empty vector or any
null or non-finite component take no part; a zero vector does, its scores are 0;
only vectors of equal length meet; rows that repeat an id are candidates each,
but never for an anchor of that id, and the anchor of an id is its row with the
smallest label and then vector; ties go to the smaller id, then the smaller
label; without anchors, positives or negatives the result is empty; vectors so
long that a score may pass 2^53 raise an error; other columns are never looked
at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklore.llm.common import materialize
from worklore.session import fresh_path

#: Anchors that travel to the tasks together, with their tree.
ANCHOR_BLOCK = 2048
#: Candidates that a task looks at together.
CANDIDATE_BLOCK = 2048
#: Integers up to this are exact in double precision.
EXACT = float(1 << 53)
FOUND = "anchor_id long, positive_id long, negative_id long, label long, positive_score long, negative_score long"
NEAREST = "anchor_id long, vec_id long, label long, score long"


def quantised(embeddings: DataFrame, scale: int = 256, relabel_every: int = 0, labels: int = 10) -> DataFrame:
    """(vec_id, label, v): usable rows, components as whole numbers floor(scale * x).

    With ``relabel_every`` the label of ids divisible by it moves to the next of ``labels``.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad)
    if relabel_every:
        moved = F.pmod("vec_id", F.lit(relabel_every)) == 0
        rows = rows.withColumn("label", F.when(moved, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


@dataclass
class Tree:
    """Anchors in an order where each comes after its parent; the root is its own."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray

    @classmethod
    def grow(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
        n = len(ids)
        order, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
        near, via, open_ = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
        edge, now = np.zeros(n), 0
        for step in range(n):
            order[step], open_[now] = now, False
            parent[step], edge[step] = via[now], near[now] if step else 0.0
            distance = np.linalg.norm(vectors - vectors[now], axis=1)
            closer = open_ & (distance < near)
            near[closer], via[closer] = distance[closer], step
            now = int(np.argmin(np.where(open_, near, np.inf)))
        return cls(ids[order], labels[order], vectors[order], parent, edge)


@dataclass
class Bounds:
    """Per anchor of the tree, bounds of the scores of one block of candidates.

    An anchor's bounds are dropped once its last child has read them.
    """

    tree: Tree
    vectors: np.ndarray

    def walk(self, wanted):
        """Yields (anchor number, candidates scored, their scores).

        ``wanted(number, low, high)`` marks the candidates to score.
        """
        norms = np.linalg.norm(self.vectors, axis=1)
        last = {int(p): k for k, p in enumerate(self.tree.parent.tolist())}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (p, e) in enumerate(zip(self.tree.parent.tolist(), self.tree.edge.tolist())):
            if k:
                # A little more than e * norm, so that rounding never narrows the bounds.
                reach = np.ceil(e * norms * (1 + 1e-9)) + 1
                low, high = held[p][0] - reach, held[p][1] + reach
                rows = np.flatnonzero(wanted(k, low, high))
            else:
                low, high = np.zeros(len(norms)), np.zeros(len(norms))
                rows = np.arange(len(norms))
            scores = self.vectors[rows] @ self.tree.vectors[k] if len(rows) < len(norms) else self.vectors @ self.tree.vectors[k]
            low[rows] = high[rows] = scores
            if last[p] == k:
                held.pop(p, None)
            if last.get(k, -1) > k:
                held[k] = (low, high)
            yield k, rows, scores


def best(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, id, label."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= floor)
        return rows[np.lexsort((labels[rows], ids[rows], -scores[rows]))[:k]]
    return np.lexsort((labels, ids, -scores))[:k]


def batches_of(batches, dim: int):
    """(ids, labels, vectors) of bounded numbers of candidates of one vector length."""
    for batch in batches:
        for at in range(0, len(batch), CANDIDATE_BLOCK):
            part = batch.slice(at, CANDIDATE_BLOCK)
            if len(part):
                flat = np.asarray(part.column(2).flatten(), np.float64).reshape(len(part), dim)
                yield np.asarray(part.column(0)), np.asarray(part.column(1)), flat


class Lists:
    """Best lists by key that a task keeps over all its batches."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, key, ids, labels, scores) -> None:
        if key in self.held:
            old = self.held[key]
            ids, labels, scores = (np.concatenate(x) for x in zip(old, (ids, labels, scores)))
        rows = best(ids, labels, scores, self.k)
        self.held[key] = ids[rows], labels[rows], scores[rows]

    def floor(self, key) -> float:
        found = self.held.get(key)
        return found[2][-1] if found is not None and len(found[2]) == self.k else -np.inf


def positives_of(candidates: DataFrame, tree, dim: int, k: int) -> DataFrame:
    """(anchor_id, vec_id, label, score): each task's k best of the anchor's own label."""

    def search(batches):
        t, lists = tree.value, Lists(k)
        for ids, labels, vectors in batches_of(batches, dim):
            def wanted(a, low, high, ids=ids, labels=labels):
                return (labels == t.labels[a]) & (high >= lists.floor(a))

            for a, rows, scores in Bounds(t, vectors).walk(wanted):
                keep = rows[(labels[rows] == t.labels[a]) & (ids[rows] != t.ids[a]) & (scores >= lists.floor(a))]
                if len(keep):
                    lists.add(a, ids[keep], labels[keep], scores[np.searchsorted(rows, keep)])
        for a, (ids, labels, scores) in lists.held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), t.ids[a])), pa.array(ids), pa.array(labels), pa.array(scores.astype(np.int64))], names=["anchor_id", "vec_id", "label", "score"]
            )

    return candidates.mapInArrow(search, NEAREST)


def negatives_of(candidates: DataFrame, tree, windows, dim: int, k: int, share: int) -> DataFrame:
    """Each task's k best negatives in the window of each (anchor, positive).

    ``windows`` holds (positive ids, their scores) by anchor number.
    """

    def search(batches):
        t, lists = tree.value, Lists(k)
        spans = windows.value
        inner = {a: (np.ceil(share * scores / 100.0), scores.astype(np.float64)) for a, (_, scores) in spans.items()}
        hull = {a: (floor.min(), top.max()) for a, (floor, top) in inner.items()}
        for ids, labels, vectors in batches_of(batches, dim):
            def wanted(a, low, high, labels=labels):
                if a not in hull:
                    return np.zeros(len(low), bool)
                return (labels != t.labels[a]) & (high >= hull[a][0]) & (low <= hull[a][1])

            for a, rows, scores in Bounds(t, vectors).walk(wanted):
                if a not in hull:
                    continue
                inside = (labels[rows] != t.labels[a]) & (ids[rows] != t.ids[a]) & (scores >= hull[a][0]) & (scores <= hull[a][1])
                rows, scores = rows[inside], scores[inside]
                for slot, (floor, top) in enumerate(zip(*inner[a])):
                    hit = (scores >= np.maximum(floor, lists.floor((a, slot)))) & (scores <= top)
                    if hit.any():
                        lists.add((a, slot), ids[rows[hit]], labels[rows[hit]], scores[hit])
        for (a, slot), (ids, labels, scores) in lists.held.items():
            n = len(ids)
            columns = [np.full(n, t.ids[a]), np.full(n, spans[a][0][slot]), ids, labels, np.full(n, spans[a][1][slot]), scores.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "negative_id", "label", "positive_score", "negative_score"])

    return candidates.mapInArrow(search, FOUND)


def mine(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``vectors`` has vec_id, label and whole-numbered v (see ``quantised``).
    Anchors are the ids divisible by ``anchor_every``.  A negative's score lies
    between ``share`` percent of the positive's and the positive's.  The driver
    holds one block of anchors at a time; its finds are written before the next.
    """
    spark = vectors.sparkSession
    vectors = vectors.withColumn("dim", F.size("v"))
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    own = vectors.where(F.pmod("vec_id", F.lit(anchor_every)) == 0).groupBy("dim", "vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    counts = {r[0]: r[1] for r in own.groupBy("dim").count().collect()}
    longest = {r[0]: r[1] for r in vectors.groupBy("dim").agg(F.max(squared)).collect()}
    for dim in counts:
        if longest[dim] >= EXACT:
            raise ArithmeticError("scores of these vectors are not whole numbers in double precision; use a smaller scale")
    blocks = {dim: -(-n // ANCHOR_BLOCK) for dim, n in counts.items()}
    cases = reduce(lambda c, d: F.when(F.col("dim") == d, F.lit(blocks[d])).otherwise(c), blocks, F.lit(1))
    anchors = materialize(own.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(3)), cases).alias("block"), "vec_id", "row.label", "row.v"), "anchors")
    path = fresh_path(spark, "negatives")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for dim, n_blocks in sorted(blocks.items()):
        candidates = vectors.where(F.col("dim") == dim).select("vec_id", "label", "v")
        for block in range(n_blocks):
            rows = anchors.where((F.col("dim") == dim) & (F.col("block") == block)).orderBy("vec_id").collect()
            if not rows:
                continue
            ids, labels = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label"))
            grown = Tree.grow(ids, labels, np.array([r["v"] for r in rows], np.float64))
            tree = spark.sparkContext.broadcast(grown)
            place = {int(i): k for k, i in enumerate(grown.ids.tolist())}
            order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id", "label")
            first = positives_of(candidates, tree, dim, positives).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
            spans: dict[int, list] = {}
            for r in first.select("anchor_id", "vec_id", "score").collect():
                spans.setdefault(place[r[0]], []).append((r[1], r[2]))
            if spans:
                windows = spark.sparkContext.broadcast({a: tuple(np.array(x, np.int64) for x in zip(*pairs)) for a, pairs in spans.items()})
                negatives_of(candidates, tree, windows, dim, negatives, share).write.mode("append").parquet(path)
                windows.unpersist()
            tree.unpersist()
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id", "label")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
