"""Text expressions: sentences, chunks, hashes, snippets.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits in tokens and characters, and the ordered split pattern.
CHUNK_TOKENS = 512
OVERLAP_TOKENS = 64
WHOLE_TOKENS = 600
ORIGINAL_CHARS = 8000
SNIPPET_CHARS = 400
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_SPACE = r"[^\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SENTENCE = r"[^\n]+\n\n|[^\n]+\n|[^.!?]*[.!?]" + SPACE + r"*|[^.!?\n]+\z"
# A kept escape (a whole surrogate pair, or any escape but \u) or a lone half.
LONE_SURROGATE = (
    r"(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\[^u])|\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
)
# File extension to language.
LANGUAGE_OF = {
    "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js",
    "py": "python", "lua": "python",
    "go": "go",
    "java": "java", "cs": "java", "kt": "java", "kts": "java",
    "rs": "rust",
    "rb": "ruby",
    "c": "cpp", "h": "cpp", "cpp": "cpp", "hpp": "cpp", "cc": "cpp",
    "swift": "swift",
    "scala": "scala", "hs": "scala",
    "php": "php",
    "sol": "sol",
    "md": "markdown", "mdx": "markdown", "ex": "markdown", "exs": "markdown",
    "html": "html", "htm": "html", "xml": "html",
    "proto": "proto",
    "rst": "rst",
}


def blank(col: Column) -> Column:
    """Nothing but white space."""
    return ~col.rlike(NOT_SPACE)


def trim_all(col: Column) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")


def sanitize_json(col: Column) -> Column:
    """Drop lone surrogate escapes from JSON text, before it is parsed."""
    return F.regexp_replace(col, LONE_SURROGATE, "$1")


def n_tokens(col: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded up."""
    return F.ceil(F.length(col) / F.lit(4)).cast("int")


# The same pattern for texts whose lines are never blank: all lines but the
# last are taken whole, and only the last is looked through for sentence ends.
_HEAD = r"\A((?s:.*)[^\n]\n\n?)"
_LINES = r"[^\n]++\n\n?"
_LAST_LINE = r"[^.!?]*+[.!?]" + SPACE + r"*+|[^.!?\n]++\z"
_FULL = r"[^\n]++\n\n|[^\n]++\n|[^.!?]*+[.!?]" + SPACE + r"*+|[^.!?\n]++\z"


def sentences(col: Column) -> Column:
    """Lines, then sentences of the last line; blank parts dropped.

    Tried at every sentence, the line patterns would read on to the end of a
    long last line each time; so a text without blank lines is cut at its last
    line break first.
    """

    def found(text: Column, pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def cut(text: Column) -> Column:
        def both(head: Column) -> Column:
            return F.concat(found(head, _LINES), found(F.substr(text, F.length(head) + 1), _LAST_LINE))

        plain = F.transform(F.array(F.regexp_extract(text, _HEAD, 1)), both)[0]
        odd = F.contains(text, F.lit("\n\n\n")) | F.startswith(text, F.lit("\n"))
        parts = F.filter(F.when(odd, found(text, _FULL)).otherwise(plain), lambda s: ~blank(s))
        return F.transform(F.array(parts), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))[0]

    return F.transform(F.array(col), cut)[0]


def pack_spans(n: Column, size: int, overlap: int, begins: Column | None = None, fit: bool = False) -> Column:
    """Greedy packing of pieces of ``n`` tokens each to spans (a, b) of piece numbers, b excluded.

    A span opens with the trailing pieces of the last one worth at most
    ``overlap`` tokens; with ``fit`` only with as many as leave room for the
    next piece.  Where ``begins`` is true a span begins anew, without overlap.
    Only numbers are folded; each run is looked back through once.
    """
    spans = "array<struct<a: int, b: int>>"
    start = F.struct(F.array().cast(spans).alias("done"), F.lit(0).alias("a"), F.lit(0).alias("used"))
    anew = F.lit(False) if begins is None else None

    def step(acc, i):
        m = F.get(n, i)
        limit = F.least(F.lit(overlap), size - m) if fit else F.lit(overlap)

        def back(t, j):
            fits = t.open & (t.used + F.get(n, j) <= limit)
            return F.when(fits, F.struct(j.alias("a"), (t.used + F.get(n, j)).alias("used"), t.open.alias("open"))).otherwise(
                F.struct(t.a.alias("a"), t.used.alias("used"), F.lit(False).alias("open"))
            )

        tail = F.aggregate(F.sequence(i - 1, acc.a, F.lit(-1)), F.struct(i.alias("a"), F.lit(0).alias("used"), F.lit(True).alias("open")), back)
        flushed = F.array_append(acc.done, F.struct(acc.a.alias("a"), i.alias("b")))
        some = i > acc.a
        fresh = anew if begins is None else F.get(begins, i)
        went = F.transform(F.array(tail), lambda t: F.struct(flushed.alias("done"), t.a.alias("a"), (t.used + m).alias("used")))[0]
        return (
            F.when(some & fresh, F.struct(flushed.alias("done"), i.alias("a"), m.alias("used")))
            .when(some & (acc.used + m > size), went)
            .otherwise(F.struct(acc.done.alias("done"), acc.a.alias("a"), (acc.used + m).alias("used")))
        )

    places = F.when(F.size(n) > 0, F.sequence(F.lit(0), F.size(n) - 1)).otherwise(F.array().cast("array<int>"))
    last = lambda acc: F.when(F.size(n) > acc.a, F.array_append(acc.done, F.struct(acc.a.alias("a"), F.size(n).alias("b")))).otherwise(acc.done)
    return F.aggregate(places, start, step, last)


def joined(parts: Column, spans: Column) -> Column:
    """The text of each span."""
    return F.transform(spans, lambda s: F.array_join(F.slice(parts, s["a"] + 1, s["b"] - s["a"]), ""))


def pack_sentences(parts: Column, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Greedy packing of sentences; each chunk opens with the tail of the last."""
    both = F.transform(F.array(parts), lambda p: F.struct(p.alias("p"), F.transform(p, n_tokens).alias("n")))
    return F.transform(both, lambda x: joined(x["p"], pack_spans(x["n"], size, overlap)))[0]


def chunks(col: Column, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, whole: int = WHOLE_TOKENS) -> Column:
    """Chunks of a text; up to ``whole`` tokens it stays in one piece."""
    return F.when(n_tokens(col) <= whole, F.array(col)).otherwise(pack_sentences(sentences(col), size, overlap))


def language(path: Column) -> Column:
    """Language of a file by its extension, null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


def is_code(path: Column) -> Column:
    return language(path).isNotNull()


def content_hash(col: Column) -> Column:
    """First 16 hex digits of the sha256 of a chunk without its header."""
    return F.substring(F.sha2(col, 256), 1, 16)


def doc_hash(*cols: Column) -> Column:
    """sha256 over fields in a fixed order; a null is told from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in cols]), 256)


def original(col: Column) -> Column:
    """The stored copy of a chunk."""
    return F.substring(col, 1, ORIGINAL_CHARS)


def norm_query(col: Column) -> Column:
    """Trim and collapse white space; ids such as ``PROJ-12`` come out as they are."""
    return F.regexp_replace(trim_all(col), SPACE + "+", " ")


def snippet(col: Column) -> Column:
    """Preview without front matter."""
    body = trim_all(F.regexp_replace(col, r"\A---[\s\S]*?---\s*", ""))
    return F.when(F.length(body) > SNIPPET_CHARS, F.concat(F.substring(body, 1, SNIPPET_CHARS), F.lit("..."))).otherwise(body)


def first_set(*cols: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def epoch_ms(col: Column) -> Column:
    return F.unix_millis(col.cast("timestamp"))


def at(col: Column) -> Column:
    """A time as text, to the second."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
