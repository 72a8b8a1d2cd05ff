import random
import re

import pytest
from pyspark.sql import functions as F

from worklore.functions import text as T
from worklore.functions.html import html_to_text
from worklore.operators import chunks as C

TEXTS = [
    "", "one", "a. b! c? d", "line\nline two\n\nlast. end", "\n\n\nstart. x", "p\n\n\nfoo bar. baz\nq", "no end\n", "   ", "a\n\n\n\nb",
    "x. " * 900, "word " * 700, "l1 w w w\n" * 400 + "tail one. tail two", "é" * 2404, "a" * 2400,
]


def random_texts(n=60):
    rnd = random.Random(3)
    bits = ["alpha", "be", "gamma delta", ". ", "! ", "?", "\n", "\n\n", " ", "\n\n\n", "x" * 90]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 900))) for _ in range(n)]


def tokens(s):
    return -(-len(s) // 4)


def split(text):
    parts = [m.group(0) for m in re.finditer(r"[^\n]+\n\n|[^\n]+\n|[^.!?]*[.!?]\s*|[^.!?\n]+\Z", text)]
    parts = [p for p in parts if p.strip()]
    return parts or [text]


def pack(text):
    if tokens(text) <= 600:
        return [text]
    out, cur = [], []
    for s in split(text):
        if cur and sum(map(tokens, cur)) + tokens(s) > 512:
            out.append("".join(cur))
            tail = []
            for p in reversed(cur):
                if sum(map(tokens, tail)) + tokens(p) > 64:
                    break
                tail.insert(0, p)
            cur = tail
        cur.append(s)
    return out + ["".join(cur)]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_sentences_and_chunks(spark):
    texts = TEXTS + random_texts()
    got = rows(spark, texts).select("id", T.sentences(F.col("text")).alias("s"), T.chunks(F.col("text")).alias("c")).orderBy("id").collect()
    for text, r in zip(texts, got):
        assert list(r.s) == split(text)
        assert list(r.c) == pack(text)


def test_chunk_invariants(spark):
    """Order kept, and over the limit only where one sentence nearly fills it.

    Blank parts are dropped, so texts are compared without white space.
    """
    texts = random_texts(30)
    for text, r in zip(texts, rows(spark, texts).select("id", T.chunks(F.col("text")).alias("c")).orderBy("id").collect()):
        longest = max(map(tokens, split(text)))
        for piece in r.c:
            assert "".join(piece.split()) in "".join(text.split())
            assert len(r.c) == 1 or tokens(piece) <= max(512, 64 + longest) + len(split(piece))


@pytest.mark.parametrize("lang", [None, "python"])
def test_file_chunks(spark, lang):
    body = "class A:\n" + "".join(f"    def f{i}(self):\n        return {i} + 1\n\n" for i in range(200))
    df = spark.createDataFrame([("a.py", body), ("b.py", "short")], "name string, body string")
    out = (C.code_chunks(df) if lang else C.chunk_files(df)).orderBy("name", "chunk_index").collect()
    long = [r.chunk for r in out if r.name == "a.py"]
    assert len(long) > 3 and all(tokens(x) <= 512 for x in long) and [r.chunk for r in out if r.name == "b.py"] == ["short"]
    assert all(x in body for x in long) and long[0].startswith("class A") and long[-1].endswith("199 + 1")


def split_recursively(s, seps, size, overlap):
    """The plain form of the file splitter."""
    sep = next(x for x in seps if x == "" or x in s)
    finer = seps[seps.index(sep) + 1 :]
    pieces = [p for p in re.split(f"(?={re.escape(sep)})", s) if p] if sep else list(s)
    out, run, used = [], [], 0

    def flush():
        merged = "".join(run).strip()
        if merged:
            out.append(merged)

    for piece in pieces:
        n = tokens(piece)
        if n >= size and finer:
            flush()
            run, used = [], 0
            out += split_recursively(piece, finer, size, overlap)
            continue
        if run and used + n > size:
            flush()
            while run and (used > overlap or used + n > size):
                used -= tokens(run.pop(0))
        run.append(piece)
        used += n
    flush()
    return out


@pytest.mark.parametrize("size, overlap, whole", [(512, 64, 600), (10, 4, 12), (6, 6, 3)])
def test_file_chunks_against_recursion(spark, size, overlap, whole):
    texts = random_texts(40 if size > 6 else 5) + ["", "x" * 3000 if size > 6 else "x" * 99, "w " * (3000 if size > 6 else 50), "\n\n\n" + "para one\n\n\n\ntwo three\n" * (300 if size > 6 else 9), "é😀" * (900 if size > 6 else 40) + "\n\nend", "(a)\\E[b]\n\n" * (400 if size > 6 else 20)]
    code = ["<body>" + "<p>one two</p><div>three<p>four" * (200 if size > 6 else 9) + "x" * (5000 if size > 6 else 99) + "</body>" + t for t in texts[:6]]
    df = spark.createDataFrame([(f"{i}.txt", t) for i, t in enumerate(texts)] + [(f"c{i}.html", t) for i, t in enumerate(code)], "name string, body string")
    got = {}
    for r in C.code_chunks(df, size=size, overlap=overlap, whole=whole).orderBy("name", "chunk_index").collect():
        got.setdefault(r.name, []).append(r.chunk)
    for name, text in [(f"{i}.txt", t) for i, t in enumerate(texts)] + [(f"c{i}.html", t) for i, t in enumerate(code)]:
        seps = (C.CODE_SEPARATORS["html"] if name.endswith("html") else []) + C.TEXT_SEPARATORS
        want = [text] if tokens(text) < whole else split_recursively(text, seps, size, overlap)
        assert got.get(name, []) == want, name


def test_prompt_and_transcript_texts(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 0, "system", "be\nkind"), (1, 2, "tool", "x"), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.prompt for r in C.prompts(turns).collect()} == {1: "System: be\nkind\n\nUser: hi\n\nAssistant: ", 2: "Assistant: "}
    spoken = spark.createDataFrame([("a", 5.0, 9.0, " two "), ("a", 0.0, 5.0, "one\n"), ("b", 0.0, 1.0, " ")], "audio_id string, start_s double, end_s double, text string")
    got = {r.audio_id: (r.text, r.duration_s, r.n_segments) for r in C.transcript_texts(spoken).collect()}
    assert got == {"a": ("one two", 9.0, 2), "b": ("", 1.0, 1)}


def test_sanitize(spark):
    df = spark.createDataFrame([(r'"a\ud83d\ude00b\ud83dc\ude00\\ud800 \n"',)], "j string")
    assert df.select(T.sanitize_json(F.col("j"))).head()[0] == r'"a\ud83d\ude00bc\\ud800 \n"'


def test_html(spark):
    html = "<html><head><title>x</title></head><body><h2>Top</h2><p>a <a href='u'>link</a> &amp; b<img src=x></p><script>no()</script><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text(F.col("h"))).head()[0] == "## Top\n\na link & b\n\n1   2"
    wrapped = spark.createDataFrame([("word " * 60,)], "h string").select(html_to_text(F.col("h"), wrap=True)).head()[0]
    assert max(map(len, wrapped.split("\n"))) <= 130 and wrapped.split() == ["word"] * 60


def test_entities(spark):
    cases = {"It&#8217;s &mdash; caf&eacute;": "It\u2019s \u2014 caf\u00e9", "a &amp;lt; b &lt;i&gt;": "a &lt; b <i>", "x &unknown; &# &": "x &unknown; &# &", "&#x1F600;&#0;&#xD800;": "\U0001f600\ufffd\ufffd", "&quot;q&quot; &apos;&#39;&#x27;": "\"q\" '''", "a&nbsp;b": "a b"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert [r[0] for r in df.select(html_to_text(F.col("h"))).collect()] == list(cases.values())


def test_prompt_blocks(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(7)] + [(1, 7, "tool", "no")], "conv_id long, turn long, role string, text string")
    blocks = [r.block for r in C.to_prompt(turns).orderBy("place").collect()]
    assert len(blocks) == 8 and "".join(blocks) == "".join(("User: " if i % 2 == 0 else "Assistant: ") + f"t{i}\n\n" for i in range(7)) + "Assistant: "


def test_mail_parts_of_any_depth(spark):
    import base64
    import json

    from worklore.sources import mail

    def leaf(kind, text):
        return {"mimeType": kind, "body": {"data": base64.urlsafe_b64encode(text.encode()).decode()}}

    def inside(part, levels):
        return part if not levels else {"mimeType": "multipart/mixed", "body": {}, "parts": [inside(part, levels - 1)]}

    rows = [(n, ("multipart/mixed", (None,), json.dumps([leaf("text/html", f"<p>html {n}</p>"), inside(leaf("text/plain", f"plain {n}"), n)]))) for n in range(9)]
    rows += [(20, ("multipart/mixed", (None,), json.dumps([inside(leaf("text/html", "<p>only</p>"), 5)]))), (21, ("multipart/mixed", (None,), "[")), (22, ("text/plain", (leaf("", "alone")["body"]["data"],), None))]
    df = spark.createDataFrame(rows, "id long, payload struct<mimeType: string, body: struct<data: string>, parts: string>")
    got = {r.id: r.body for r in mail.with_body(df).collect()}
    assert got == {**{n: f"plain {n}" for n in range(9)}, 20: "only", 21: "", 22: "alone"}


def test_mail_dates(spark):
    from worklore.sources import mail

    lines = ["Mon, 1 Jan 2024 10:00:00 +0000 (UTC)", "1 Jan 2024 10:00:00 GMT", "Mon, 1 Jan 2024 10:00 +0000", "Mon, 1 Jan 2024 05:00:00 EST", "Mon, 01 Jan 2024 11:00:00 +0100", "1 Jan 2024 10:00", "2024-01-01T10:00:00Z", "nothing"]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "d string").select(F.unix_seconds(mail.mail_date(F.col("d")))).collect()]
    assert out == [1704103200] * 7 + [None]
