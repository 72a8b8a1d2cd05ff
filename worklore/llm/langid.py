"""Language identification of code-switched text with a linear-chain CRF.

Words are labelled with languages.  A word's features are its prefixes and
suffixes, its letter n-grams, and a lexicon entry for the word as a whole, all
hashed into one weight table; learned transitions join neighbours.  The model
is trained on windows of labelled documents, some spliced from two documents of
different languages so that switches are seen, by gradient ascent on the
conditional likelihood.  Forward-backward gives every word's marginals; the
document's language is the one with the largest sum of them over its letters.

Chains of a whole batch run as one: the first word of a document forgets what
was before, and the products of transition matrices are taken over stretches
side by side, so a very long document costs no more per word than short ones.

Defined cases: ``und`` with score 0 for a null text or one without a letter;
without any labelled document every text is ``und``; languages tie to the one
first in order; repeated rows score alike.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklore.llm import textbytes as tb
from worklore.llm.common import fold, sampled

#: Bound of the training sample per language, and windows of words taken of it.
SAMPLE = 600
WINDOW, WINDOWS, EPOCHS, RATE = 48, 6000, 3, 0.4
BITS = 17
#: Parts of the sample that are trained on side by side; their models are averaged bucket by bucket in Spark.
WORKERS = 4
CACHE_WORDS = 500_000
BLOCK_BYTES = 2 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: Letters: A-Z, a-z and every byte of a longer character.
NO_LETTER = tb.byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def lower(block: tb.Block) -> tb.Block:
    """Lower-case A-Z and the capitals of Latin-1 (second byte after 0xC3)."""
    data = tb.LOWER[block.data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return tb.Block(data + capital.astype(np.uint8) * 0x20, block.offsets, block.first_row)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs: affixes of 1-3 bytes, n-grams of 2-3 bytes, and the word itself."""
    size = ends - starts
    words = np.arange(len(starts))
    who, code = [], []

    def gram(at: np.ndarray, n: int, owner: np.ndarray, salt: int) -> None:
        key = np.full(len(at), salt, tb.U64)
        for k in range(n):
            key = (key << tb.U64(8)) | data[at + k].astype(tb.U64)
        who.append(owner)
        code.append(tb.mix(key))

    for n in (1, 2, 3):
        fits = size >= n
        gram(starts[fits], n, words[fits], 10 + n)
        gram(ends[fits] - n, n, words[fits], 20 + n)
    for n in (2, 3):
        room = np.maximum(size - n + 1, 0)
        owner = np.repeat(words, room)
        at = np.repeat(starts, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        gram(at, n, owner, 30 + n)
    order = np.argsort(starts, kind="stable")
    lexicon = np.empty(len(starts), tb.U64)
    lexicon[order] = tb.hash_words(data, starts[order], ends[order])
    who.append(words)
    code.append(tb.mix(lexicon + tb.U64(40)))
    return np.concatenate(who), (np.concatenate(code) >> tb.U64(64 - bits)).astype(np.int64)


def emissions(weights: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Score per word and language: the mean of its features' weights, scaled."""
    who, bucket = pairs
    size = np.maximum(1, np.bincount(who, minlength=n))
    return np.stack([np.bincount(who, weights=weights[bucket, c], minlength=n) for c in range(weights.shape[1])], 1) / np.sqrt(size)[:, None]


def _normal(m: np.ndarray) -> np.ndarray:
    return m / m.sum(axis=tuple(range(1, m.ndim)), keepdims=True)


def forward_backward(emit: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward, inward) of each position of many chains laid end to end.

    A pair of neighbours has labels i, j with a probability in proportion to
    ``forward[before, i] * exp(step[i, j]) * inward[after, j]``.

    ``first`` marks chain beginnings.  Stretches of equal length are worked on
    side by side: products of transition matrices per stretch, then the vectors
    at stretch borders, then all positions from the borders inwards.
    """
    n, labels = emit.shape
    if not n:
        return (np.zeros((0, labels)),) * 3
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    e = np.ones((rows * width, labels))
    e[:n] = np.exp(emit - emit.max(1, keepdims=True))
    restart = np.zeros(rows * width, bool)
    restart[:n], restart[n:] = first, True
    e, restart = e.reshape(rows, width, labels), restart.reshape(rows, width)
    trans, start = np.exp(step), np.exp(begin)
    reset = np.repeat(start[None, :], labels, 0)
    # m[r, t][i, j]: weight of moving from label i before position t to j at it.
    move = lambda t: np.where(restart[:, t, None, None], reset, trans) * e[:, t, None, :]
    product = np.repeat(np.eye(labels)[None], rows, 0)
    for t in range(width):
        product = _normal(product @ move(t))
    into = np.empty((rows, labels))
    out = np.empty((rows, labels))
    v = np.ones(labels) / labels
    for r in range(rows):
        into[r] = v
        v = v @ product[r]
        v /= v.sum()
    v = np.ones(labels)
    for r in range(rows - 1, -1, -1):
        out[r] = v
        v = product[r] @ v
        v /= v.sum()
    forward = np.empty((rows, width, labels))
    a = into
    for t in range(width):
        a = _normal(np.einsum("ri,rij->rj", a, move(t)))
        forward[:, t] = a
    back = np.empty((rows, width, labels))
    b = out
    for t in range(width - 1, -1, -1):
        back[:, t] = b
        b = _normal(np.einsum("rij,rj->ri", move(t), b))
    flat = lambda x: x.reshape(-1, labels)[:n]
    return _normal(flat(forward * back)), flat(forward), flat(e * back)


def marginals(emit: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Label probabilities of each position."""
    return forward_backward(emit, first, step, begin)[0]


def _words(block: tb.Block) -> tuple[tb.Block, tb.Words]:
    block = lower(block)
    return block, tb.words(block, NO_LETTER)


def train(texts: pa.Array, labels: np.ndarray, n_labels: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, transitions and start scores by AdaGrad on windows of words."""
    turn = np.random.default_rng(seed)
    pieces = []
    for block in tb.blocks(texts):
        block, found = _words(block)
        for r in range(block.rows):
            low, high = found.bounds[r], found.bounds[r + 1]
            for at in range(low, high, WINDOW):
                stop = min(at + WINDOW, high)
                pieces.append((block, found.starts[at:stop], found.ends[at:stop], labels[block.first_row + r]))
    if not pieces:
        return np.zeros((1 << BITS, n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    turn.shuffle(pieces)
    pieces = pieces[:WINDOWS]
    featured = [(word_features(b.data, s, e), len(s), y) for b, s, e, y in pieces]
    w, step, begin = np.zeros((1 << BITS, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    gw, gs, gb = np.full_like(w, 1e-2), np.full_like(step, 1e-2), np.full_like(begin, 1e-2)
    for _ in range(EPOCHS):
        order = turn.permutation(len(featured))
        for k in range(0, len(order), 32):
            batch = [featured[i] for i in order[k : k + 32]]
            size = np.array([n for _, n, _ in batch])
            base = np.cumsum(size) - size
            who = np.concatenate([p[0] + b for (p, _, _), b in zip(batch, base)])
            bucket = np.concatenate([p[1] for p, _, _ in batch])
            gold = np.repeat([y for _, _, y in batch], size)
            first = np.zeros(size.sum(), bool)
            # Every second window goes on from the one before: a spliced, code-switched chain.
            first[base[::2]] = True
            emit = emissions(w, (who, bucket), len(gold))
            p, forward, inward = forward_backward(emit, first, step, begin)
            error = -p
            error[np.arange(len(gold)), gold] += 1
            share = error / np.sqrt(np.maximum(1, np.bincount(who, minlength=len(gold))))[:, None] / len(gold) * 32
            ids, back = np.unique(bucket, return_inverse=True)
            grad = np.stack([np.bincount(back, weights=share[who, c], minlength=len(ids)) for c in range(n_labels)], 1)
            gw[ids] += grad**2
            w[ids] += RATE * grad / np.sqrt(gw[ids])
            inner = np.flatnonzero(~first)
            pair = forward[inner - 1][:, :, None] * np.exp(step)[None] * inward[inner][:, None, :]
            grad = -_normal(pair).sum(0)
            np.add.at(grad, (gold[inner - 1], gold[inner]), 1)
            grad /= len(gold)
            gs += grad**2
            step += RATE * 0.1 * grad / np.sqrt(gs)
            grad = np.bincount(gold[first], minlength=n_labels) - p[first].sum(0)
            grad = grad / max(1, first.sum())
            gb += grad**2
            begin += RATE * 0.1 * grad / np.sqrt(gb)
    return w.astype(np.float32), step, begin


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    step: np.ndarray
    begin: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for block in tb.blocks(texts, BLOCK_BYTES):
            block, found = _words(block)
            if not len(found.starts):
                continue
            hashes, at, back = np.unique(tb.hash_words(block.data, found.starts, found.ends), return_index=True, return_inverse=True)
            known = _CACHE.lookup(self.name, hashes, len(self.languages))
            new = np.flatnonzero(np.isnan(known[:, 0]))
            if len(new):
                known[new] = emissions(self.weights, word_features(block.data, found.starts[at[new]], found.ends[at[new]]), len(new))
                _CACHE.add(hashes[new], known[new])
            first = np.zeros(len(back), bool)
            first[found.bounds[:-1][found.counts > 0]] = True
            p = marginals(known[back], first, self.step, self.begin)
            size = (found.ends - found.starts).astype(float)
            mass = np.stack([tb.per_row_sums(p[:, c] * size, found) for c in range(p.shape[1])], 1)
            total = mass.sum(1)
            best = np.argmax(mass.round(9), 1)
            # A row whose words are all longer characters may hold no letter at all.
            plain = ~tb.NOT_ALNUM & ~tb.byte_set((0x30, 0x39), (0x80, 0xFF))
            sure = np.add.reduceat(np.append(plain[block.data], False), np.minimum(block.offsets[:-1], len(block.data))) > 0
            for r in np.flatnonzero(total > 0).tolist():
                if sure[r] or any(c.isalpha() for c in bytes(block.data[block.offsets[r] : block.offsets[r + 1]]).decode()):
                    names[block.first_row + r] = self.languages[best[r]]
                    scores[block.first_row + r] = min(1.0, mass[r, best[r]] / total[r])
        return names, scores


class _Words:
    """Emission scores of words this Python worker has met, for one model at a time."""

    def __init__(self) -> None:
        self.model, self.keys, self.values = "", np.zeros(0, tb.U64), np.zeros((0, 1))

    def lookup(self, model: str, hashes: np.ndarray, labels: int) -> np.ndarray:
        if model != self.model or len(self.keys) > CACHE_WORDS:
            self.model, self.keys, self.values = model, np.zeros(0, tb.U64), np.zeros((0, labels))
        if not len(self.keys):
            return np.full((len(hashes), labels), np.nan)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes)[:, None], self.values[at], np.nan)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.values = np.insert(self.keys, at, hashes), np.insert(self.values, at, values, axis=0)


_CACHE = _Words()


def fit(docs: DataFrame, bound: int = SAMPLE, parts: int = 4, held_out: int = 2) -> Model:
    """Train on about ``bound`` documents per language outside the held-out fold, in parallel, and average."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    picked = sampled(rows, F.col("doc_id"), bound, F.col("lang"))
    number = F.element_at(F.create_map(*[F.lit(x) for pair in zip(languages, range(len(languages))) for x in pair]), F.col("lang"))
    picked = picked.select("doc_id", "text", number.cast("int").alias("y"))

    def work(key, found):
        found = found.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        w, step, begin = train(found["text"].combine_chunks(), found["y"].to_numpy(), len(languages))
        used = np.flatnonzero(np.abs(w).sum(1))
        # Transitions and start scores follow the weights as rows of their own.
        at = np.concatenate([used, (1 << BITS) + np.arange(len(languages) + 1)])
        rows = np.concatenate([w[used], step, begin[None]])
        return pa.table({"at": at, "v": pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel().astype(np.float32)), len(languages)).cast(pa.list_(pa.float32()))})

    parts_of = picked.withColumn("worker", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(WORKERS)))
    each = parts_of.groupBy("worker").applyInArrow(work, "at long, v array<float>")
    workers = picked.select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(WORKERS))).distinct().count()
    mean = each.groupBy("at").agg(*[(F.sum(F.col("v")[c]) / workers).alias(f"v{c}") for c in range(len(languages))]).toArrow()
    size = (1 << BITS) + len(languages) + 1
    rows = np.zeros((size, len(languages)))
    rows[mean["at"].to_numpy()] = np.stack([mean[f"v{c}"].to_numpy() for c in range(len(languages))], 1)
    return Model(languages, rows[: 1 << BITS].astype(np.float32), rows[1 << BITS : -1], rows[-1])


def identify(docs: DataFrame, model: Model, parts: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document: its language and that language's share of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def report(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "text").mapInArrow(report, SCHEMA)
