"""HTML to text as one chain of column expressions."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement), applied in this order; entities are decoded between the two lists.
TAG_STEPS = [
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(script|style|head|noscript)\b[^>]*>.*?</(script|style|head|noscript)\s*>", ""),
    (r"(?i)<img\b[^>]*>", ""),
    (r"\s+", " "),
    (r"(?i)<h1\b[^>]*>\s*", "\n\n# "),
    (r"(?i)<h2\b[^>]*>\s*", "\n\n## "),
    (r"(?i)<h3\b[^>]*>\s*", "\n\n### "),
    (r"(?i)<li\b[^>]*>\s*", "\n * "),
    (r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>\s*", "   "),
    (r"(?i)\s*<br\s*/?>\s*", "\n"),
    (r"(?i)</?(tr|ul|ol|pre|div|section|article|nav|header|footer|main|aside|blockquote|body|html)\b[^>]*>", "\n"),
    (r"(?i)</?(p|h[1-6]|table)\b[^>]*>", "\n\n"),
    (r"<[a-zA-Z/!][^>]*>", ""),
]
SPACE_STEPS = [
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"\A\s+", ""),
    (r"\s+\z", ""),
]
WRAP_CHARS = 130
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"


def _replaced(col: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        col = F.regexp_replace(col, pattern, to.replace("$", r"\$"))
    return col


def decode_entities(col: Column) -> Column:
    """Named and numeric character references in one pass; unknown names stay as they are."""
    known = {f"&{name};": " " if name == "nbsp" else chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
    named = F.from_json(F.lit(json.dumps(known)), "map<string,string>")

    def one(t: Column) -> Column:
        digits = F.regexp_extract(t, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(F.lower(F.substring(t, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(~F.startswith(t, F.lit("&")) | (F.length(t) == 1), t).when(F.substring(t, 2, 1) == "#", char).otherwise(F.coalesce(F.try_element_at(named, t), t))

    tokens = F.regexp_extract_all(col, F.lit(_ENTITY), F.lit(0))
    return F.array_join(F.transform(tokens, one), "")


def html_to_text(col: Column, wrap: bool = False) -> Column:
    """Tags out, headings as ``#``, rows on lines, links keep their text."""
    plain = F.transform(F.array(_replaced(col, TAG_STEPS)), lambda x: F.when(F.contains(x, F.lit("&")), decode_entities(x)).otherwise(x))[0]
    out = _replaced(plain, SPACE_STEPS)
    if wrap:
        out = F.regexp_replace(out, rf"([^\n]{{1,{WRAP_CHARS}}})(?: +|(?=\n)|\z)", "$1\n")
        out = F.regexp_replace(F.regexp_replace(out, r"\n\n\n+", "\n\n"), r"\s+\z", "")
    return out
