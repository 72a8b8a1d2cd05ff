"""Toxicity by two Kneser-Ney language models, one per class.

A word is spelt by its bytes between two word marks; each model predicts every
byte from up to five before it.  Above ``SHARED`` bytes of history the counts
are the class's own; at and below it both models back off to one table of
continuation counts taken from both classes, so an expression that neither
class has often is judged by its spelling, alike for both.  A document's
evidence is the difference of its two log-likelihoods per byte; a logistic
curve, fitted on labelled documents the models have not seen, turns it into a
score.

Counts are taken from every labelled document outside the held-out fold; only
the curve is fitted on a bounded sample, with counts that leave its rows out.
Up to ``GRAMS`` counted grams a model is a few sorted arrays, and scoring looks
every distinct word up once per task.  Beyond that the counts stay in tables:
the distinct grams of the words to be scored are joined with them level by
level, and words, then documents, add up what their grams got.

Defined cases: null, empty and wordless texts get the score of no evidence;
without labels of both classes every score is the share of toxic labels (0
without labels); repeated rows score alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.llm import textbytes as tb
from worklore.llm.common import fold, free_name, give_back, materialize, text_key, tidy
from worklore.llm.labelled import all_labelled

#: A quarter of so many labelled rows per class fits the curve; counts have no bound.
SAMPLE = 10_000
#: Counted grams a model in memory may have (about 60 bytes each with all levels).
GRAMS = 1_000_000
#: Gram rows gathered in a task before they are summed and handed on.
PENDING = 1 << 19
ORDER, SHARED, DISCOUNT = 6, 2, 0.75
MARK = 0x20
#: Words kept per task between blocks, for speed only.
CACHE_WORDS = 1_000_000
#: Bytes of text, and new words, worked on at once.
BLOCK_BYTES, BLOCK_WORDS = 2 << 20, 40_000
#: Bytes of text whose grams are counted at once; a byte takes about 200 while it is counted.
COUNT_BYTES = 512 << 10
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_LOW = tb.U64((1 << 56) - 1)


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another between marks: (bytes, place in its word, word) of each position.

    A word's closing mark is the next one's opening mark; place 0 is the very first mark.
    """
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(begin[-1] + 1, MARK, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[begin[word] + 1 + inner] = data[np.repeat(starts, size) + inner]
    owner = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(1, begin[-1] + 1) - begin[owner]
    return text, place, owner


def grams(text: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the n bytes up to each position after the first mark, last byte lowest."""
    out = [text[1:].astype(tb.U64)]
    padded = np.concatenate([np.zeros(order, np.uint8), text])
    for n in range(2, order + 1):
        back = padded[order + 2 - n : order + 2 - n + len(place)]
        out.append(out[-1] | (back.astype(tb.U64) << tb.U64(8 * (n - 1))))
    return out


def gram_blocks(texts: pa.Array, labels: np.ndarray, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, count in class 0, count in class 1) of one block after another; the top byte of a key is its length."""
    for block in tb.blocks(texts, COUNT_BYTES):
        block = tb.folded(block)
        found = tb.words(block, tb.NOT_ALNUM)
        if not len(found.starts):
            continue
        text, place, owner = spell(block.data, found.starts, found.ends)
        toxic = labels[block.first_row + found.rows][owner].astype(bool)
        parts = []
        for n, keys in enumerate(grams(text, place, order), 1):
            # A gram may begin with a mark but not reach over it; shorter ones are whole only at a word's begin.
            fits = place >= n - 1
            whole = fits if n == order else fits & (place == n - 1)
            tagged = keys[whole] | tb.U64(n << 56)
            values, at = np.unique(tagged, return_inverse=True)
            one = np.bincount(at, weights=toxic[whole], minlength=len(values))
            parts.append((values, np.bincount(at, minlength=len(values)) - one, one))
        yield tuple(np.concatenate(c) for c in zip(*parts))


def count_grams(texts: pa.Array, labels: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``gram_blocks`` finds, in one piece."""
    parts = list(gram_blocks(texts, labels, order))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, tb.U64), np.zeros(0), np.zeros(0))


def merged(parts: Iterator[tuple[np.ndarray, np.ndarray]], pending: int = PENDING) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of a task with equal keys summed, as far as ``pending`` rows go."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows > pending:
            held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
            rows = len(held[0][0])
            if rows > pending // 2:
                yield held[0]
                held, rows = [], 0
    if held:
        yield _summed(*(np.concatenate(c) for c in zip(*held)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(keys, return_inverse=True)
    return values, np.stack([np.bincount(at, weights=c, minlength=len(values)) for c in counts.T], 1) if len(values) else np.zeros((0, counts.shape[1]))


@dataclass
class Level:
    """Counts of grams, and totals and kinds of their histories, per class."""

    keys: np.ndarray
    counts: np.ndarray
    histories: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Level:
        before = keys >> tb.U64(8)
        histories, totals = _summed(before, counts)
        _, kinds = _summed(before, (counts > 0).astype(float))
        return cls(keys, counts, histories, totals, kinds)


def _find(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of ``values`` for the keys, zeros where there is none."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where((table[at] == keys)[:, None], values[at], 0.0)


def mixed(seen: np.ndarray, total: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Discounted counts of a level with what they leave given to the level below."""
    return np.where(total > 0, (np.maximum(seen - DISCOUNT, 0.0) + DISCOUNT * kinds * p) / np.maximum(total, 1e-9), p)


@dataclass
class Model:
    levels: list[Level]
    curve: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_evidence(self, data, starts, ends) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        text, place, owner = spell(data, starts, ends)
        keys = grams(text, place, ORDER)
        first = self.levels[0]
        p = (_find(first.keys, first.counts, keys[0]) + 1.0) / (first.counts.sum(0) + 256.0)
        for n in range(2, ORDER + 1):
            level = self.levels[n - 1]
            at = np.flatnonzero(place >= n - 1)
            key = keys[n - 1][at]
            total, kinds = _find(level.histories, level.totals, key >> tb.U64(8)), _find(level.histories, level.kinds, key >> tb.U64(8))
            seen = _find(level.keys, level.counts, key)
            p[at] = mixed(seen, total, kinds, p[at])
        return np.bincount(owner, weights=np.log(p[:, 1]) - np.log(p[:, 0]), minlength=len(starts))

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per row: evidence per byte, and words."""
        per_byte, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for block in tb.blocks(texts, BLOCK_BYTES):
            block = tb.folded(block)
            found = tb.words(block, tb.NOT_ALNUM)
            here = slice(block.first_row, block.first_row + block.rows)
            if not len(found.starts):
                continue
            hashes, first, back = np.unique(tb.hash_words(block.data, found.starts, found.ends), return_index=True, return_inverse=True)
            known = _CACHE.lookup(self.name, hashes)
            new = np.flatnonzero(np.isnan(known))
            if len(new):
                for k in range(0, len(new), BLOCK_WORDS):
                    part = new[k : k + BLOCK_WORDS]
                    known[part] = self.word_evidence(block.data, found.starts[first[part]], found.ends[first[part]])
                _CACHE.add(hashes[new], known[new])
            size = tb.per_row_sums((found.ends - found.starts + 1).astype(float), found)
            per_byte[here] = tb.per_row_sums(known[back], found) / np.maximum(size, 1)
            count[here] = found.counts
        return per_byte, count

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.levels:
            return np.full(len(texts), self.curve[-1])
        return 1 / (1 + np.exp(-np.clip(shape(*self.evidence(texts)) @ self.curve, -35, 35)))


class _Words:
    """Evidence of words this Python worker has met, for one model at a time."""

    def __init__(self) -> None:
        self.model, self.keys, self.values = "", np.zeros(0, tb.U64), np.zeros(0)

    def lookup(self, model: str, hashes: np.ndarray) -> np.ndarray:
        if model != self.model or len(self.keys) > CACHE_WORDS:
            self.model, self.keys, self.values = model, np.zeros(0, tb.U64), np.zeros(0)
        if not len(self.keys):
            return np.full(len(hashes), np.nan)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], np.nan)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.values = np.insert(self.keys, at, hashes), np.insert(self.values, at, values)


_CACHE = _Words()


def shape(per_byte: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Inputs of the curve: evidence per byte, the same against chance in a text of that length, the length, a constant."""
    root = np.sqrt(count)
    return np.stack([per_byte * 10, per_byte * root * 3, root / 20, np.ones(len(per_byte))], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighted to their share in the corpus."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.05] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def assemble(keys: np.ndarray, counts: np.ndarray, order: int = ORDER, shared: int = SHARED) -> list[Level]:
    """Levels 1..order from summed whole-gram counts; lower ones count distinct bytes before a gram."""
    length = (keys >> tb.U64(56)).astype(int)
    levels: list[Level] = []
    above = None
    for n in range(order, 0, -1):
        own = length == n
        grams_n, values = keys[own] & _LOW, counts[own]
        if above is not None:
            kinds = (above.counts > 0).astype(float)
            if n <= shared:
                kinds = np.repeat(kinds.max(1)[:, None], 2, 1)
            grams_n = np.concatenate([grams_n, above.keys & tb.U64((1 << 8 * n) - 1)])
            values = np.concatenate([values, kinds])
        if n <= shared and len(values):
            values[: own.sum()] = values[: own.sum()].sum(1, keepdims=True)
        above = Level.of(*_summed(grams_n, values))
        levels.insert(0, above)
    return levels


def _tag(n: int) -> Column:
    return F.lit(n << 56)


def _last(k: Column, n: int) -> Column:
    """Key of a gram's last n bytes."""
    return k.bitwiseAND(F.lit((1 << 8 * n) - 1)).bitwiseOR(_tag(n))


def _of(df: DataFrame, n: int) -> DataFrame:
    return df.where((F.col("k") >= _tag(n)) & (F.col("k") < _tag(n + 1)))


def _history(k: Column, n: int) -> Column:
    return F.shiftright(k.bitwiseAND(F.lit(int(_LOW))), 8).bitwiseOR(_tag(n))


@dataclass
class Tables:
    """A model whose counts stay in Spark tables; no size of it is bounded by memory.

    ``grams[n]`` is (k, c0, c1) and ``histories[n]`` is (h, t0, t1, d0, d1) for n above ``SHARED``;
    ``pairs`` has the chances (k, p0, p1) of all two-byte grams.
    """

    grams: dict[int, DataFrame]
    histories: dict[int, DataFrame]
    pairs: DataFrame
    curve: np.ndarray

    @classmethod
    def of(cls, summed: DataFrame) -> Tables:
        """From summed whole-gram counts (k, c0, c1), as ``assemble`` does it."""
        grams, histories, above = {}, {}, None
        for n in range(ORDER, SHARED, -1):
            own = _of(summed, n).select("k", F.col("c0").cast("double").alias("c0"), F.col("c1").cast("double").alias("c1"))
            if above is not None:
                own = own.unionByName(above.select(_last(F.col("k"), n).alias("k"), *(F.when(F.col(c) > 0, 1.0).otherwise(0.0).alias(c) for c in ("c0", "c1"))))
            above = grams[n] = materialize(own.groupBy("k").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), f"toxicity-grams-{n}")
            totals = [F.sum(f"c{y}").alias(f"t{y}") for y in (0, 1)] + [F.sum(F.when(F.col(f"c{y}") > 0, 1.0).otherwise(0.0)).alias(f"d{y}") for y in (0, 1)]
            histories[n] = materialize(above.groupBy(_history(F.col("k"), n).alias("h")).agg(*totals), f"toxicity-histories-{n}")
        own = _of(summed, SHARED).select("k", (F.col("c0") + F.col("c1")).cast("double").alias("c"))
        own = own.unionByName(above.select(_last(F.col("k"), SHARED).alias("k"), F.when(F.greatest("c0", "c1") > 0, 1.0).otherwise(0.0).alias("c")))
        low = own.groupBy("k").agg(F.sum("c").alias("c")).orderBy("k").toArrow()
        keys, counts = low["k"].to_numpy().view(tb.U64) & _LOW, np.repeat(low["c"].to_numpy()[:, None], 2, 1)
        two = Level.of(keys, counts)
        one = Level.of(*_summed(keys & tb.U64(0xFF), (counts > 0).astype(float)))
        every = np.arange(1 << 16, dtype=tb.U64)
        p = (_find(one.keys, one.counts, every & tb.U64(0xFF)) + 1.0) / (one.counts.sum(0) + 256.0)
        before = every >> tb.U64(8)
        p = mixed(_find(two.keys, two.counts, every), _find(two.histories, two.totals, before), _find(two.histories, two.kinds, before), p)
        pairs = pa.table({"k": (every | tb.U64(SHARED << 56)).view(np.int64), "p0": p[:, 0], "p1": p[:, 1]})
        return cls(grams, histories, summed.sparkSession.createDataFrame(pairs), np.zeros(4))

    def chances(self, keys: DataFrame) -> DataFrame:
        """(k, p0, p1) for whole grams ``k``; every join key stands for at most 256 rows."""
        wanted = {}
        for n in range(ORDER, SHARED, -1):
            here = _of(keys, n).select("k")
            if n < ORDER:
                here = here.unionByName(wanted[n + 1].select(_last(F.col("k"), n).alias("k")))
            wanted[n] = materialize(here.distinct(), f"toxicity-wanted-{n}")
        out = p = self.pairs
        for n in range(SHARED + 1, ORDER + 1):
            rows = wanted[n].join(self.grams[n], "k", "left").withColumn("h", _history(F.col("k"), n)).join(self.histories[n], "h", "left")
            below = p.select(F.col("k").alias("b"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            rows = rows.withColumn("b", _last(F.col("k"), n - 1)).join(below, "b").na.fill(0.0)
            mixes = []
            for y in (0, 1):
                c, t, d, q = (F.col(f"{x}{y}") for x in "ctdq")
                mixes.append(F.when(t > 0, (F.greatest(c - DISCOUNT, F.lit(0.0)) + DISCOUNT * d * q) / F.greatest(t, F.lit(1e-9))).otherwise(q).alias(f"p{y}"))
            p = materialize(rows.select("k", *mixes), f"toxicity-chances-{n}")
            out = out.unionByName(p)
        return out

    def evidence(self, rows: DataFrame) -> DataFrame:
        """(id, y, n_rows, per_byte, n_words) for each distinct (id, y, text) of the rows.

        Evidence is summed on a grid of 2^-30, in any order alike.
        """
        rows = rows.select("id", "y", text_key(F.col("text")).alias("text_key"), "text")
        words = materialize(rows.select("text").mapInArrow(_word_grams, "w long, k long, n long").groupBy("w", "k").agg(F.max("n").alias("n")), "toxicity-words")
        each = self.chances(words.select("k")).select("k", F.round((F.log("p1") - F.log("p0")) * (1 << 30)).cast("long").alias("e"))
        values = words.join(each, "k").groupBy("w").agg(F.sum(F.col("n") * F.col("e")).alias("e"))
        found = rows.mapInArrow(_document_words, "id long, y int, text_key long, w long, bytes long, n long").join(values, "w")
        key = ["id", "y", "text_key"]
        found = found.select(*key, F.lit(0).cast("long").alias("r"), (F.col("n") * F.col("e")).alias("e"), (F.col("n") * F.col("bytes")).alias("s"), "n")
        ones = rows.select(*key, F.lit(1).cast("long").alias("r"), *(F.lit(0).cast("long").alias(c) for c in "esn"))
        sums = found.unionByName(ones).groupBy(*key).agg(*(F.sum(c).alias(c) for c in "resn"))
        per_byte = F.when(F.col("s") > 0, F.col("e") / F.col("s") / (1 << 30)).otherwise(0.0)
        return sums.select(*key, F.col("r").alias("n_rows"), per_byte.alias("per_byte"), F.expr("n div r").alias("n_words"))

    def scores(self, rows: DataFrame) -> DataFrame:
        """(id, text_key, n_rows, score) of (id, text) rows."""
        curve = self.curve

        def report(batches):
            for batch in batches:
                s = 1 / (1 + np.exp(-np.clip(shape(np.asarray(batch["per_byte"]), np.asarray(batch["n_words"])) @ curve, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["text_key"], batch["n_rows"], pa.array(s)], names=["id", "text_key", "n_rows", "score"])

        return self.evidence(rows.withColumn("y", F.lit(0))).mapInArrow(tidy(report), "id long, text_key long, n_rows long, score double")


def _word_grams(batches):
    """(word, gram, times) of the distinct words of each block."""
    for batch in batches:
        for block in tb.blocks(batch.column(0)):
            block = tb.folded(block)
            found = tb.words(block, tb.NOT_ALNUM)
            if not len(found.starts):
                continue
            hashes, first = np.unique(tb.hash_words(block.data, found.starts, found.ends), return_index=True)
            for a in range(0, len(first), BLOCK_WORDS):
                part = first[a : a + BLOCK_WORDS]
                text, place, owner = spell(block.data, found.starts[part], found.ends[part])
                keys = grams(text, place, ORDER)
                length = np.minimum(place + 1, ORDER)
                tagged = np.choose(length - 1, keys) | (length.astype(tb.U64) << tb.U64(56))
                order = np.lexsort((tagged, owner))
                tagged, owner = tagged[order], owner[order]
                begins = np.flatnonzero(np.concatenate([[True], (tagged[1:] != tagged[:-1]) | (owner[1:] != owner[:-1])]))
                times = np.diff(np.concatenate([begins, [len(tagged)]]))
                columns = [hashes[a + owner[begins]].view(np.int64), tagged[begins].view(np.int64), times]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w", "k", "n"])


def _document_words(batches):
    """(id, y, text key, word, its bytes with a mark, times) of each row."""
    for batch in batches:
        for block in tb.blocks(batch.column(3)):
            block = tb.folded(block)
            found = tb.words(block, tb.NOT_ALNUM)
            if not len(found.starts):
                continue
            hashes = tb.hash_words(block.data, found.starts, found.ends)
            order = np.lexsort((hashes, found.rows))
            row, hashes, size = found.rows[order], hashes[order], (found.ends - found.starts + 1)[order]
            begins = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]))
            times = np.diff(np.concatenate([begins, [len(hashes)]]))
            keys = [batch.column(c).take(pa.array(block.first_row + row[begins])) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(hashes[begins].view(np.int64)), pa.array(size[begins]), pa.array(times)], names=["id", "y", "text_key", "w", "bytes", "n"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, most: int = GRAMS) -> Model | Tables:
    """Count grams of all labelled rows in parallel; fit the curve on a bounded part, with its rows left out of the counts."""
    apart = F.col("picked") & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0)
    rows = all_labelled(docs, labels, label, bound).withColumn("apart", apart)
    share = dict(labels.where(F.col(label).isin(0, 1)).where(fold(F.col("doc_id"), 5) != 0).groupBy(F.col(label).cast("int")).count().collect())
    total = sum(share.values())
    toxic = share.get(1, 0) / total if total else 0.0
    if len(share) < 2:
        return Model([], np.array([toxic]))

    def count(batches):
        def parts():
            for batch in batches:
                left = np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
                for out in (False, True):
                    at = pa.array(np.flatnonzero(left == out))
                    for keys, zero, one in gram_blocks(batch.column(0).take(at), np.asarray(batch.column(1).take(at))):
                        none = np.zeros_like(zero)
                        yield keys, np.stack([none, none, zero, one] if out else [zero, one, none, none], 1)

        for keys, counts in merged(parts()):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts.T)], names=["k", "c0", "c1", "a0", "a1"])

    sums = [F.sum(c).alias(c) for c in ("c0", "c1", "a0", "a1")]
    summed = materialize(rows.select("text", "y", "apart").mapInArrow(tidy(count), "k long, c0 long, c1 long, a0 long, a1 long").groupBy("k").agg(*sums), "toxicity-counts")
    seen = summed.where("c0 + c1 > 0")
    if seen.isEmpty():
        return Model([], np.array([toxic]))
    every = summed.select("k", (F.col("c0") + F.col("a0")).alias("c0"), (F.col("c1") + F.col("a1")).alias("c1"))
    for_curve = rows.where("apart").select(F.col("doc_id").alias("id"), "y", "text")
    if summed.count() > most:
        model = Tables.of(every)
        known = Tables.of(seen.select("k", "c0", "c1")).evidence(for_curve).select("per_byte", "n_words", "y", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
        known = known.select("per_byte", "n_words", "y").toPandas()
    else:
        table = summed.toArrow()
        keys = table["k"].to_numpy().view(tb.U64)
        c0, c1, a0, a1 = (table[c].to_numpy().astype(float) for c in ("c0", "c1", "a0", "a1"))
        own = c0 + c1 > 0
        shared = docs.sparkSession.sparkContext.broadcast(Model(assemble(keys[own], np.stack([c0, c1], 1)[own]), np.zeros(4)))

        def weigh(batches):
            for batch in batches:
                per_byte, n = shared.value.evidence(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(per_byte), pa.array(n), batch.column(1)], names=["per_byte", "n_words", "y"])

        known = for_curve.select("text", "y").mapInArrow(tidy(weigh), "per_byte double, n_words long, y int").toPandas()
        model = Model(assemble(keys, np.stack([c0 + a0, c1 + a1], 1)), np.zeros(4))
    known = known.sort_values(["per_byte", "n_words", "y"])
    model.curve = fit_curve(shape(known["per_byte"].to_numpy(), known["n_words"].to_numpy()), known["y"].to_numpy(), toxic)
    return model


def score(docs: DataFrame, model: Model | Tables, threshold: float = 0.5, parts: int = 5) -> DataFrame:
    """One row per document with its score; ``held_out`` marks the fold that was not learned from."""
    if isinstance(model, Tables):
        found = model.scores(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
        found = found.select("id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
        return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), parts) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def report(batches):
        for batch in batches:
            s = shared.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), parts) == 0).alias("held_out"), "text").mapInArrow(tidy(report), SCHEMA)


def remove_toxic(docs: DataFrame, model: Model | Tables, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, without those scored toxic."""
    if isinstance(model, Tables):
        id_name, key_name = free_name(docs, "_id"), free_name(docs, "_key")
        scored = model.scores(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
        bad = scored.where(F.col("score") >= threshold).select(F.col("id").alias(id_name), F.col("text_key").alias(key_name))
        return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)) & (text_key(F.col("text")) == F.col(key_name)), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    give_back()
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(tidy(keep), docs.schema)
