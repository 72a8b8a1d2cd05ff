"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled once on the driver: the normaliser (spaces to the piece mark, one in
front of each text), the pieces, and byte fallback for characters without one.
A state is the piece read last.  An arc reads a piece; its weight is 1, or
infinite if the pair of pieces cannot stand side by side, which is so when some
merge over their border would have come before the last merge inside them.
Exactly one path per input has finite weight, and it is the pair-merge
tokenisation, so the tropical shortest path is found position by position.

A text falls apart where two characters never meet inside a piece; no path
crosses such a border, so the parts are composed one by one, each distinct part
once per task.  Decoding concatenates the bytes of the pieces.

Defined cases: null and empty texts have no tokens and decode to the empty
text; a text that holds the piece mark itself decodes to a space there; very
long words and runs of spaces are composed whole; other columns are never
looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from worklore.llm import textbytes as tb

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts and piece pairs kept per Python worker, for speed only.
CACHE_PARTS, CACHE_PAIRS = 500_000, 150_000
NORMAL, BYTE = 1, 6
CHARS = 0x110000


@dataclass
class Transducer:
    """Arcs and weights of the compiled model."""

    ids: dict[str, int]
    rank: dict[str, float]
    split: dict[str, tuple[str, str]]
    byte_ids: list[int]
    spellings: list[bytes]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids))
        self.runs = {len(p) for p in self.ids if p == MARK * len(p)}
        self._pairs: dict[tuple[str, str], bool] = {}
        chars = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.char_class = np.zeros(CHARS, np.uint16)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.meets = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        number = {c: k + 1 for k, c in enumerate(chars)}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                self.meets[number[a], number[b]] = True
        self.spelt = np.frombuffer(b"".join(self.spellings), np.uint8)
        self.spelt_at = np.concatenate([[0], np.cumsum([len(s) for s in self.spellings])])

    def side_by_side(self, left: str, right: str) -> bool:
        """Whether no merge over the border comes before the merges that made the two pieces."""
        known = self._pairs.get((left, right))
        if known is not None:
            return known
        u, v, limit = left, right, np.inf
        while True:
            if self.rank.get(u + v, np.inf) < limit:
                fits = False
                break
            ru, rv = self._made(u), self._made(v)
            if ru < 0 and rv < 0:
                fits = True
                break
            # Undo the later merge; of two alike the right one was later, and the border's comes before it.
            if ru > rv:
                limit, u = ru, self.split[u][1]
            else:
                limit, v = rv + 0.5, self.split[v][0]
        if len(self._pairs) > CACHE_PAIRS:
            self._pairs.clear()
        self._pairs[left, right] = fits
        return fits

    def _made(self, piece: str) -> float:
        return self.rank[piece] if piece in self.split else -1.0

    def path(self, part: str) -> list[str]:
        """Pieces of the one path of finite weight."""
        n = len(part)
        weight, last, back = [0.0] + [np.inf] * n, [""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                piece = part[begin:end]
                if weight[begin] + 1 < weight[end] and (piece in self.split or end - begin == 1) and (begin == 0 or self.side_by_side(last[begin], piece)):
                    weight[end], last[end], back[end] = weight[begin] + 1, piece, begin
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def compose(self, part: str) -> list[int]:
        """Token numbers of one part."""
        spaces = len(part) - len(part.lstrip(MARK))
        if spaces < 2:
            return self._numbers(self.path(part))
        # Pieces of marks alone have the least weight of all and are made last, from the left.
        pieces = self.path(part[spaces - 1 :])
        run = spaces if pieces[0] == MARK else spaces - 1
        stack: list[int] = []
        for _ in range(run):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return self._numbers([MARK * k for k in stack] + pieces[1 if pieces[0] == MARK else 0 :])

    def _numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            number = self.ids.get(p)
            out += [number] if number is not None else [self.byte_ids[b] for b in p.encode()]
        return out

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers, bounds per text) of some texts."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = self.char_class[chars]
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.meets[kinds[:-1], kinds[1:]]
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(chars))
        keys, first, back = np.unique(tb.hash_words(chars, starts, ends, char_codes()), return_index=True, return_inverse=True)
        at, size, flat = _CACHE.fetch(self, keys, whole, starts, ends, first)
        size_of = size[back]
        low = np.cumsum(size_of) - size_of
        tokens = flat[np.arange(size_of.sum()) - np.repeat(low, size_of) + np.repeat(at[back], size_of)]
        upto = np.concatenate([[0], np.cumsum(size_of)])
        return tokens, upto[np.searchsorted(starts, bounds)]

    def decode_block(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds per text), the space in front of each text taken off."""
        size = self.spelt_at[tokens + 1] - self.spelt_at[tokens]
        low = np.cumsum(size) - size
        data = self.spelt[np.arange(size.sum()) - np.repeat(low, size) + np.repeat(self.spelt_at[tokens], size)]
        edges = np.concatenate([[0], np.cumsum(size)])[bounds]
        lead = np.zeros(len(bounds) - 1, bool)
        filled = np.diff(edges) > 0
        lead[filled] = data[edges[:-1][filled]] == 0x20
        kept = np.ones(len(data), bool)
        kept[edges[:-1][lead]] = False
        return data[kept], edges - np.concatenate([[0], np.cumsum(lead)])


_CODES: list[np.ndarray] = []


def char_codes() -> np.ndarray:
    """A random 64-bit code per character, made when first asked for."""
    if not _CODES:
        _CODES.append(tb.mix(np.arange(1, CHARS + 1, dtype=tb.U64) * tb.U64(0xC2B2AE3D27D4EB4F)))
    return _CODES[0]


class _Parts:
    """Token numbers of the parts this Python worker has met, for one model at a time."""

    def __init__(self) -> None:
        self._reset("")

    def _reset(self, model: str) -> None:
        self.model, self.keys = model, np.zeros(0, tb.U64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def fetch(self, model: Transducer, keys: np.ndarray, whole: str, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        """(place, size) of each key's tokens, and the array they are in."""
        if model.name != self.model or len(self.keys) > CACHE_PARTS:
            self._reset(model.name)
        spot = np.searchsorted(self.keys, keys)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            found = [model.compose(whole[s:e]) for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            size = np.array([len(f) for f in found], np.int64)
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, np.array([i for f in found for i in f], np.int32)])
            self.keys, self.at, self.size = np.insert(self.keys, spot[new], keys[new]), np.insert(self.at, spot[new], at), np.insert(self.size, spot[new], size)
            spot = np.searchsorted(self.keys, keys)
        return self.at[spot], self.size[spot], self.flat


_CACHE = _Parts()


def compile_model(path: str = MODEL_PATH) -> Transducer:
    """Read a pair-merge model with byte fallback and an identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
        raise ValueError("only pair-merge models with the identity normaliser are compiled")
    ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
    byte_ids = [k for k, p in enumerate(model.pieces) if p.type == BYTE]
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback")
    rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL and len(p.piece) > 1}
    split = {}
    for piece in rank:
        last = last_merge(piece, rank)
        if last:
            split[piece] = last
    spellings = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
    for value, k in enumerate(byte_ids):
        spellings[k] = bytes([value])
    return Transducer(ids, rank, split, byte_ids, spellings)


def last_merge(piece: str, rank: dict[str, float]) -> tuple[str, str] | None:
    """The two halves whose merge makes the piece, or None if merging its characters ends elsewhere."""
    parts = list(piece)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: (rank.get(parts[k] + parts[k + 1], np.inf), k))
        if parts[best] + parts[best + 1] not in rank:
            return None
        if len(parts) == 2:
            return parts[0], parts[1]
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return None


def _blocks(column: pa.Array):
    for block in tb.blocks(column, 2 << 20):
        yield block, column.slice(block.first_row, block.rows).to_pylist()


def encode(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_model(path))

    def work(batches):
        for batch in batches:
            for block, texts in _blocks(batch.column(1)):
                tokens, bounds = shared.value.encode_block([t or "" for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first_row, block.rows), pa.array(np.diff(bounds)), lists], names=["doc_id", "n_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(compile_model(path))

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            for row in range(0, len(lists), 256):
                part = lists.slice(row, 256).fill_null([]) if lists.null_count else lists.slice(row, 256)
                size = np.asarray(part.value_lengths())
                data, edges = shared.value.decode_block(np.asarray(part.flatten()), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                text = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 256), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """Encode and decode every document: token counts, a digest of the numbers (little-endian, 4 bytes each), and whether the text came back."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_model(path))
    fields = "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, same boolean"

    def work(batches):
        for batch in batches:
            model = shared.value
            is_byte = np.zeros(len(model.spellings), np.int64)
            is_byte[model.byte_ids] = 1
            for block, texts in _blocks(batch.column(1)):
                tokens, bounds = model.encode_block([t or "" for t in texts])
                data, edges = model.decode_block(tokens, bounds)
                fallback = np.concatenate([[0], np.cumsum(is_byte[tokens])])[bounds]
                raw, source = tokens.astype("<i4"), block.data
                digest = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
                same = [np.array_equal(data[a:b], source[c:d]) for a, b, c, d in zip(edges[:-1], edges[1:], block.offsets[:-1], block.offsets[1:])]
                columns = [pa.array(np.diff(bounds)), pa.array(np.diff(fallback)), pa.array(digest), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first_row, block.rows), *columns], names=[f.split()[0] for f in fields.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, fields)
