"""Documents with every awkward case, for all operators."""

from __future__ import annotations

import random

WORDS = "the of and river stone house green walk night paper light water mountain small road again under over bright sing".split()
BAD = "idiot scum moron trash"


def sentence(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + rng.choice(["", "er", "ing", "ly"]) for _ in range(n)]


def texts(seed: int = 1, groups: int = 20) -> list[str | None]:
    """Near and exact copies, shared passages, empty and odd texts."""
    rng = random.Random(seed)
    passage = " ".join(sentence(rng, 60))
    out: list[str | None] = []
    for g in range(groups):
        base = sentence(rng, rng.randint(1, 120))
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
            lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
            if g % 3 == 0:
                lines.insert(rng.randint(0, len(lines)), passage)
            out.append("\n".join(lines))
    return [*out, "", None, "   ", "\n\n\n", "A b", "a B", "word " * 3000, "日本 😀 — é", "x" * 5000]


def frame(spark, rows: list[tuple], **extra):
    """(doc_id, text) rows with columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, pos int, n long, cid long, text_key long, word string"
    data = [(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3, 4, "w") for i, t in rows]
    return spark.createDataFrame(data, schema)


def awkward(spark, seed: int = 1):
    found = texts(seed)
    rows = list(enumerate(found))
    rows += [(3, found[3]), (None, found[5]), (None, None), (None, "")]
    return frame(spark, rows), rows


def empty(spark):
    return frame(spark, [])
