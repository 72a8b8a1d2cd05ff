"""Fill-in-middle: texts cut in prefix, middle and suffix at unit borders.

A batch of texts is looked at as UTF-8 bytes in words of 64 bits.  Bytes that
end a unit (a line or a character) are marked by word arithmetic, one mark per
byte, and ``bitwise_count`` gives the marks of each word.  Their running sum is
the index: the number of units of a text is the difference of two ranks, and
the end of its k-th unit is found by searching the sum for the word and then
selecting the mark inside the word, again by arithmetic.  Where to cut follows
from a hash of the document's id, so a repeated run cuts alike.

Defined cases: a null text is empty; an empty text has no units and stays
plain, as does a text that holds a marker; a null id is hashed as no digits;
rows that repeat an id are cut alike; a text of any length is one row and is
cut whole; an empty table gives an empty table; other columns are never looked
at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.llm import textbytes as tb

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<[PSM]>"
U64 = np.uint64
ONES, HIGH, LOW7 = U64(0x0101010101010101), U64(0x8080808080808080), U64(0x7F7F7F7F7F7F7F7F)
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian words, with at least one byte of zeros behind them."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def equal_marks(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``."""
    x = words ^ (ONES * U64(byte))
    return ~(((x & LOW7) + LOW7) | x) & HIGH


def start_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that starts a character, i.e. is not 10xxxxxx."""
    return ~(words & ~(words << U64(1))) & HIGH


def line_end_marks(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Line feeds, and the last byte of every text that has any."""
    marks = equal_marks(words, 0x0A)
    last = offsets[1:][np.diff(offsets) > 0] - 1
    np.bitwise_or.at(marks, last >> 3, U64(0x80) << ((last & 7) << 3).astype(U64))
    return marks


def char_end_marks(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes followed by one that starts a character; what follows a text always does."""
    begins = start_marks(words)
    after = np.append(begins[1:], HIGH)
    return (begins >> U64(8)) | (after << U64(56))


UNITS = {"line": line_end_marks, "char": char_end_marks}


@dataclass
class Marks:
    """Marks with their running count: ``before[w]`` marks stand in words below w."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> Marks:
        return cls(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in front of each byte position."""
        word, inside = at >> 3, ((at & 7) << 3).astype(U64)
        below = self.words[word] & ((U64(1) << inside) - U64(1))
        return self.before[word] + np.bitwise_count(below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """Byte positions of the marks of these numbers, counted from 1."""
        word = np.searchsorted(self.before, number, "left") - 1
        wanted = (number - self.before[word]).astype(U64)
        # Byte j of the product counts the marks in bytes 0 to j of the word.
        counts = (self.words[word] >> U64(7)) * ONES
        reached = ((counts | HIGH) - wanted * ONES) & HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


def cut_points(data: np.ndarray, offsets: np.ndarray, unit: str, draws: tuple[np.ndarray, np.ndarray]):
    """(units, end of prefix, end of middle) per text; the ends are byte positions.

    Each draw modulo units + 1 is a number of units; the smaller one ends the
    prefix and the larger one the middle.
    """
    marks = Marks.of(UNITS[unit](as_words(data), offsets))
    rank = marks.rank(offsets)
    first, units = rank[:-1], np.diff(rank)
    ends = []
    for draw in draws:
        count = draw % (units + 1)
        some = count > 0
        end = offsets[:-1].copy()
        end[some] = marks.select(first[some] + count[some]) + 1
        ends.append(end)
    return units, np.minimum(*ends), np.maximum(*ends)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of seed and id."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(code, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """One row per document: units, form (plain, psm or spm), sizes of the parts and the output text.

    ``unit`` is line or char.  ``fim_percent`` of the texts are rearranged, and
    ``spm_percent`` of those put the suffix first.
    """
    if unit not in UNITS:
        raise ValueError(f"no unit {unit}")
    tags = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def arrange(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            held = np.asarray(pc.match_substring_regex(texts, MARKERS).to_numpy(zero_copy_only=False), bool)
            numbers = [np.asarray(c) for c in batch.columns[2:6]]
            for block in tb.blocks(texts):
                span = slice(block.first_row, block.first_row + block.rows)
                h1, h2, h3, h4 = (x[span] for x in numbers)
                at = block.offsets.astype(np.int64)
                units, one, two = cut_points(block.data, at, unit, (h1, h2))
                chars = Marks.of(start_marks(as_words(block.data)))
                places = [chars.rank(x) for x in (at[:-1], one, two)]
                plain = (units == 0) | held[span] | (h3 % 100 >= fim_percent)
                suffix_first = h4 % 100 < spm_percent
                raw, out = block.data.tobytes(), []
                for r, (a, b, c, d) in enumerate(zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist())):
                    if plain[r]:
                        out.append(raw[a:d])
                    elif suffix_first[r]:
                        out.append(b"".join((tags[1], raw[c:d], tags[0], raw[a:b], tags[2], raw[b:c])))
                    else:
                        out.append(b"".join((tags[0], raw[a:b], tags[1], raw[c:d], tags[2], raw[b:c])))
                sizes = [pa.array(np.diff(p, axis=0)[0], mask=plain) for p in (places[:2], places[1:])]
                form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
                columns = [batch.column(0).slice(block.first_row, block.rows), pa.array(units), pa.array(form.tolist(), pa.string()), *sizes, pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(key, seed))])
    return rows.mapInArrow(arrange, RESULT)


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form: no part holds a marker, so the three cut it exactly."""
    part = F.split(output, MARKERS, -1)
    get = lambda k: F.get(part, F.lit(k))
    return (
        F.when(form == "psm", F.concat(get(1), get(3), get(2)))
        .when(form == "spm", F.concat(get(2), get(3), get(1)))
        .otherwise(output)
    )


def digests(made: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
