"""Secret scanning with one combined deterministic automaton.

The trigger patterns of all rules are compiled together: Thompson automaton,
subset construction over byte classes, minimisation, transition array.  A batch
of texts is then read once: it is cut into lanes at bytes after which every
state is where a fresh start would be, and all lanes step through the array
side by side.  A trigger is a part that every span worth keeping contains, so
texts without one are done.  In the lines where a trigger ends, the minimised
automaton of each rule finds the leftmost, longest, non-overlapping matches,
and those that are too short are dropped.

Defined cases: a null text is an empty one; offsets are code points; no match
runs over a line end; repeated documents are each reported; other columns are
never looked at.
"""

from __future__ import annotations

import hashlib
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from worklore.llm import textbytes as tb

LANE = 1024
#: Walks of one line meet at every so many bytes at the latest.
STRIDE = 8
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` then ``body``; the match or its body needs ``least`` characters."""

    kind: str
    head: str
    body: str
    least: int
    trigger: str
    of_body: bool = False
    any_case: bool = False
    base: bool = False


# Triggers count no more than they must: two counters in one automaton multiply its states.
# Fixed values of the contract: the three base kinds, in order.
_HEAD = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
RULES = (
    Rule("assign", _HEAD, r"[A-Za-z0-9+/_.=-]+", 8, _HEAD + r"[A-Za-z0-9+/_.=-]", of_body=True, any_case=True, base=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16, r"AKIA[A-Z0-9]", base=True),
    Rule("hex", r"", r"[0-9a-f]+", 32, r"[0-9a-f]{32}", base=True),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 40, r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 15, r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("pem", r"-----BEGIN\x20", r"[A-Z0-9\x20]*PRIVATE\x20KEY-----", 0, r"PRIVATE\x20KEY-----"),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, r"eyJ[A-Za-z0-9_-]+\."),
)


class Nfa:
    """Thompson automaton over bytes, built from Python's parse tree of a pattern."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, fold: bool) -> int:
        """Append a parsed sequence after ``start``; gives its end."""
        for op, arg in tree:
            start = self._node(op, arg, start, fold)
        return start

    def _node(self, op, arg, start: int, fold: bool) -> int:
        if op in (sre.LITERAL, sre.IN):
            end = self.state()
            self.moves[start].append((_bytes_of([(op, arg)] if op is sre.LITERAL else arg, fold), end))
            return end
        if op is sre.SUBPATTERN:
            return self.add(arg[3], start, fold)
        if op is sre.BRANCH:
            end = self.state()
            for branch in arg[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(branch, begin, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start, fold)
            end = self.state()
            self.empty[start].append(end)
            if most is sre.MAXREPEAT:
                begin = self.state()
                self.empty[start].append(begin)
                last = self.add(inner, begin, fold)
                self.empty[last] += [begin, end]
            else:
                for _ in range(most - least):
                    start = self.add(inner, start, fold)
                    self.empty[start].append(end)
            return end
        raise ValueError(f"a rule uses {op}, which is not supported")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def _bytes_of(items, fold: bool) -> frozenset[int]:
    out: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE:
            out |= set(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"a rule's set uses {op}, which is not supported")
    if fold:
        out |= {ord(chr(b).swapcase()) for b in out if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(out)


class Barren:
    """Places and states of a text from which no match ends any more, at every ``STRIDE``-th byte.

    One bit each, so a text of n bytes takes n * states / (8 * STRIDE) bytes.
    """

    def __init__(self, size: int, states: int) -> None:
        self.size, self.states, self.bits = size, states, None

    def holds(self, at: int, state: int) -> bool:
        place = at // STRIDE * self.states + state
        return self.bits is not None and bool(self.bits[place >> 3] >> (place & 7) & 1)

    def add(self, at: int, state: int) -> None:
        if self.bits is None:
            self.bits = bytearray(((self.size // STRIDE + 1) * self.states >> 3) + 1)
        place = at // STRIDE * self.states + state
        self.bits[place >> 3] |= 1 << (place & 7)


@dataclass
class Dfa:
    """``table[state * classes + byte_class[byte]]`` is the next state; 0 is the start."""

    byte_class: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    classes: int
    resets: np.ndarray

    def longest(self, text: bytes, at: int, barren: Barren | None = None) -> int:
        """End of the longest match that starts at ``at``, or -1 (anchored automata).

        What a walk reads after its last match leads nowhere from there on; with
        ``barren`` that is kept, and a later walk that meets it stops.
        """
        state, last = 0, at if self.accept[0] else -1
        table, classes, byte_class, accept = self.moves, self.classes, self.symbols, self.accepting
        met: list[int] = []
        for k in range(at, len(text)):
            state = table[state * classes + byte_class[text[k]]]
            if state == self.dead:
                break
            if accept[state]:
                last = k + 1
                met.clear()
            elif barren is not None and not k % STRIDE:
                if barren.holds(k, state):
                    break
                met.append(k * len(accept) + state)
        for place in met:
            barren.add(*divmod(place, len(accept)))
        return last

    @property
    def dead(self) -> int:
        return self._dead

    def __post_init__(self) -> None:
        # Lists of numbers: single steps are quicker than through arrays.
        self.moves, self.symbols, self.accepting = self.table.tolist(), self.byte_class.tolist(), (self.accept != 0).tolist()
        rows = self.table.reshape(-1, self.classes)
        stuck = np.flatnonzero((rows == np.arange(len(rows))[:, None]).all(1) & (self.accept == 0))
        self._dead = int(stuck[0]) if len(stuck) else -1


def compile_dfa(patterns: list[tuple[str, bool]], anchored: bool) -> Dfa:
    """Subset construction of all patterns together, then minimisation; bit r of ``accept`` is pattern r."""
    nfa = Nfa()
    begin = nfa.state()
    for bit, (pattern, fold) in enumerate(patterns):
        first = nfa.state()
        nfa.empty[begin].append(first)
        end = nfa.add(sre_parse.parse(pattern), first, fold)
        nfa.accepts[end] = nfa.accepts.get(end, 0) | 1 << bit
    # Bytes that no set tells apart share a class.
    signature: dict[tuple, int] = {}
    sets = list({s for moves in nfa.moves for s, _ in moves})
    byte_class = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(signature))]
    home = nfa.closure([begin])
    numbers, queue, rows = {home: 0}, [home], []
    for subset in queue:
        row = []
        for b in sample:
            moved = nfa.closure([t for s in subset for chars, t in nfa.moves[s] if b in chars])
            moved = moved if anchored else moved | home
            if moved not in numbers:
                numbers[moved] = len(numbers)
                queue.append(moved)
            row.append(numbers[moved])
        rows.append(row)
    table = np.array(rows, np.int64)
    accept = np.array([np.bitwise_or.reduce([nfa.accepts.get(s, 0) for s in q] or [0]) for q in queue], np.int64)
    # Moore's refinement: split blocks until their members agree on all next blocks.
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.concatenate([block[:, None], block[table]], 1), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)
    renumber = np.empty(len(order), np.int64)
    renumber[order] = np.arange(len(order))
    block, chosen = renumber[block], first[order]
    small = block[table[chosen]]
    resets = (small == small[0]).all(0) & (accept[chosen][small[0]] == 0)
    kind = np.uint16 if small.max() < 65536 else np.int64
    return Dfa(byte_class, small.astype(kind).ravel(), accept[chosen], len(sample), resets[byte_class])


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    trigger: Dfa
    whole: list[Dfa]
    heads: list[Dfa | None]
    starts: list[np.ndarray]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    whole = [compile_dfa([(r.head + r.body, r.any_case)], True) for r in rules]
    heads = [compile_dfa([(r.head, r.any_case)], True) if r.of_body else None for r in rules]
    starts = [d.table[: d.classes][d.byte_class] != d.dead for d in whole]
    return Scanner(rules, compile_dfa([(r.trigger, r.any_case) for r in rules], False), whole, heads, starts)


def trigger_ends(data: np.ndarray, dfa: Dfa) -> np.ndarray:
    """Places of the bytes at which some trigger ends, in one pass over all lanes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    safe = np.flatnonzero(dfa.resets[data])
    wanted = np.searchsorted(safe, np.arange(LANE, n, LANE))
    cuts = np.unique(safe[wanted[wanted < len(safe)]] + 1)
    edges = np.concatenate([[0], cuts[cuts < n], [n]])
    begin, size = edges[:-1], np.diff(edges)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    symbols = dfa.byte_class[data]
    table, accept, classes = dfa.table, dfa.accept != 0, dfa.classes
    state = np.zeros(len(begin), np.int64)
    active, found = len(begin), []
    for step in range(int(size[0])):
        while size[active - 1] <= step:
            active -= 1
        at = begin[:active] + step
        state = table[state[:active] * classes + symbols[at]].astype(np.int64)
        ended = accept[state]
        if ended.any():
            found.append(at[ended])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def line_spans(line: bytes, scanner: Scanner) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of what each rule keeps in one line.

    A start whose walk meets a place and state that an earlier one left without
    a match ends there, so a line takes time in proportion to its length.
    """
    out = []
    codes = np.frombuffer(line, np.uint8)
    for number, rule in enumerate(scanner.rules):
        free, whole = 0, scanner.whole[number]
        barren = Barren(len(line), len(whole.accept))
        for at in np.flatnonzero(scanner.starts[number][codes]).tolist():
            if at < free:
                continue
            end = whole.longest(line, at, barren)
            if end <= at:
                continue
            free = end
            head = scanner.heads[number]
            size = end - at - (head.longest(line[at:end], 0) if head else 0)
            if size >= rule.least:
                out.append((at, number, end))
    return out


def scan_batch(column: pa.Array, scanner: Scanner) -> dict[int, list[tuple[int, int, int]]]:
    """Spans by row, (start, rule number, end) in code points; rows without any are left out."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for block in tb.blocks(column):
        sizes = np.diff(block.offsets)
        # A line end after every row keeps the automaton from running into the next one.
        shift = np.repeat(np.arange(block.rows), sizes)
        apart = np.full(len(block.data) + block.rows, 10, np.uint8)
        apart[np.arange(len(block.data)) + shift] = block.data
        begins = block.offsets + np.arange(block.rows + 1)
        ends = trigger_ends(apart, scanner.trigger)
        if not len(ends):
            continue
        breaks = np.flatnonzero(apart == 10)
        # Code points before each byte: all bytes but those that go on with one.
        points = np.concatenate([[0], np.cumsum((apart & 0xC0) != 0x80)])
        for line in np.unique(np.searchsorted(breaks, ends)).tolist():
            low, high = (int(breaks[line - 1]) + 1 if line else 0), int(breaks[line])
            row = int(np.searchsorted(begins, low, "right")) - 1
            before = points[begins[row]]
            for s, rule, e in line_spans(apart[low:high].tobytes(), scanner):
                out.setdefault(row + block.first_row, []).append((int(points[low + s] - before), rule, int(points[low + e] - before)))
    return {row: sorted(spans) for row, spans in out.items()}


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans as text."""
    scanner = compile_rules(rules)
    kinds = [r.kind for r in rules]
    empty = hashlib.sha256(b"").hexdigest()

    def report(batches):
        for batch in batches:
            n = len(batch)
            counts = {k: np.zeros(n, np.int64) for k in ("assign", "access", "hex")}
            digests, texts = [empty] * n, [""] * n
            for row, spans in scan_batch(batch.column(1), scanner).items():
                named = [(f"{kinds[r]}:{s}:{e}", r) for s, r, e in spans]
                texts[row] = ",".join(t for t, _ in named)
                digests[row] = hashlib.sha256(",".join(t for t, r in named if rules[r].base).encode()).hexdigest()
                for _, r in named:
                    if kinds[r] in counts:
                        counts[kinds[r]][row] += 1
            columns = [batch.column(0), *(pa.array(c) for c in counts.values()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(report, SCHEMA)
