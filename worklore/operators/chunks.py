"""Chunk tables: explode, headers, metadata, file splitting, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions import text as T
from worklore.session import spread_small

# Separators from coarse to fine; a language puts its own first.
TEXT_SEPARATORS = ["\n\n", "\n", " ", ""]
CODE_SEPARATORS = {
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault "],
    "python": ["\nclass ", "\ndef ", "\n\tdef "],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase "],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase "],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch "],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue "],
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase "],
    "swift": ["\nfunc ", "\nclass ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase "],
    "scala": ["\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nmatch ", "\ncase "],
    "php": ["\nfunction ", "\nclass ", "\nif ", "\nforeach ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase "],
    "sol": ["\npragma ", "\nusing ", "\ncontract ", "\ninterface ", "\nlibrary ", "\nconstructor ", "\ntype ", "\nfunction ", "\nevent ", "\nmodifier ", "\nerror ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\ndo while ", "\nassembly "],
    "markdown": ["\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n"],
    "html": ["<body>", "<div>", "<p>", "<br>", "<li>", "<h1>", "<h2>", "<h3>", "<h4>", "<h5>", "<h6>", "<span>", "<table>", "<tr>", "<td>", "<th>", "<ul>", "<ol>", "<header>", "<footer>", "<nav>", "<head>", "<style>", "<script>", "<meta>", "<title>", " "],
    "proto": ["\nmessage ", "\nservice ", "\nenum ", "\noption ", "\nimport ", "\nsyntax "],
    "rst": ["\n===\n", "\n---\n", "\n***\n", "\n.. "],
}


def explode_chunks(docs: DataFrame, ready: str | None = None, spread: bool = True) -> DataFrame:
    """One row per chunk; a ready array of more than one chunk is taken as it is.

    A document in one piece keeps its id and has no parent.  ``spread`` is for
    inputs that may lie in one file.
    """
    made = T.chunks(F.col("content"))
    arr = made if ready is None else F.when(F.size(F.col(ready)) > 1, F.col(ready)).otherwise(made)
    rows = (spread_small(docs, "id") if spread else docs).withColumn("_chunks", arr)
    return (
        rows.select("*", F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("_i", "chunk"))
        .withColumn("parent_doc_id", F.when(F.col("_n") > 1, F.col("id")))
        .withColumn("chunk_index", F.when(F.col("_n") > 1, F.col("_i")))
        .withColumn("total_chunks", F.when(F.col("_n") > 1, F.col("_n")))
        .withColumn(
            "id", F.when(F.col("_n") > 1, F.concat("id", F.lit("_chunk_"), F.col("_i").cast("string"))).otherwise(F.col("id"))
        )
        .drop("_chunks", "_n", "_i")
    )


def header(m: Callable[[str], Column], source: Column) -> Column:
    """Context lines put in front of a chunk; ``m`` gives a metadata column."""

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    def only(tag: str, value: Column) -> Column:
        return F.when(source == tag, value)

    day = F.try_to_timestamp(T.first_set(*[m(c).cast("string") for c in ("created_at", "date", "start", "updated_at")]))
    return F.concat_ws(
        "\n",
        line("Document: ", T.first_set(m("title"), m("subject"), m("name"))),
        F.concat(F.lit("Source: "), source),
        only("jira", line("Project: ", m("project"))),
        only("jira", line("Type: ", m("issue_type"))),
        only("jira", line("Status: ", m("status"))),
        only("jira", line("Priority: ", m("priority"))),
        only("slack", line("Channel: #", m("channel"))),
        only("slack", line("Author: ", m("author"))),
        only("slack", F.when(m("thread_ts") != "", "(thread reply)")),
        only("gmail", line("From: ", m("sender"))),
        only("gmail", line("Subject: ", m("subject"))),
        only("drive", line("Path: ", m("folder_path"))),
        only("drive", line("Type: ", m("mime_type"))),
        only("confluence", F.when(m("space") != "", line("Space: ", T.first_set(m("space_name"), m("space"))))),
        only("confluence", F.when(m("type") == "comment", "(page comment)")),
        only("calendar", line("When: ", T.at(m("start")))),
        only("calendar", line("Location: ", m("location"))),
        F.concat(F.lit("Date: "), F.date_format(day, "yyyy-MM-dd")),
    )


def header_of(chunks: DataFrame) -> Column:
    """The header of each row; columns not there count as null."""
    have = set(chunks.columns)

    def m(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    return header(m, F.col("source"))


def indexed_text(head: Column, chunk: Column) -> Column:
    """Header, blank line, chunk."""
    return F.concat(head, F.lit("\n\n"), chunk)


def with_header(chunks: DataFrame) -> DataFrame:
    """``indexed`` = header, blank line, chunk; columns not there count as null."""
    return chunks.withColumn("indexed", indexed_text(header_of(chunks), F.col("chunk")))


def flatten_meta(df: DataFrame, meta: list[str], created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Epoch columns for the two index dates and the rest as JSON without nulls."""
    return df.select(
        "*",
        F.unix_millis(F.try_to_timestamp(F.col(created).cast("string"))).alias("created_ms"),
        F.unix_millis(F.try_to_timestamp(F.col(updated).cast("string"))).alias("updated_ms"),
        F.to_json(F.struct(*meta)).alias("metadata_json"),
    )


def index_rows(docs: DataFrame, ready: str | None = None) -> DataFrame:
    """Documents to index rows: chunk, header, hash, stored copy."""
    return (
        with_header(explode_chunks(docs, ready))
        .withColumn("content_hash", T.content_hash(F.col("chunk")))
        .withColumn("original", T.original(F.col("chunk")))
    )


# -- file bodies ---------------------------------------------------------------


def _split_once(span: Column, seps: Column, size: int, count: Callable[[Column], Column]) -> Column:
    """A span (text, next separator) cut in front of each place of the first separator that occurs in it.

    Pieces of ``size`` tokens or more are still to be cut, as long as a finer
    separator is left.  ``anew`` marks pieces that no chunk joins with those before.
    """
    occurs = F.filter(F.sequence(span["k"], F.size(seps) - 1), lambda j: (F.get(seps, j) == "") | F.contains(span["p"], F.get(seps, j)))

    def cut(j: Column) -> Column:
        sep = F.get(seps, j)
        pattern = F.when(sep == "", "").otherwise(F.concat(F.lit(r"(?=\Q"), sep, F.lit(r"\E)")))

        def pieces(parts: Column) -> Column:
            long = lambda i: (count(F.get(parts, i)) >= size) & (sep != "")
            return F.transform(
                parts,
                lambda p, i: F.struct(p.alias("p"), (j + 1).alias("k"), count(p).alias("n"), ((i == 0) | long(i - 1)).alias("anew")),
            )

        return F.transform(F.array(F.split(span["p"], pattern, -1)), pieces)[0]

    return F.transform(F.array(F.get(occurs, F.lit(0))), cut)[0]


def _columns(found: Column) -> Column:
    """The texts, sizes and marks of pieces as one array each."""
    return F.struct(found["p"].alias("p"), found["n"].alias("n"), found["anew"].alias("anew"))


def split_body(body: Column, seps: Column, size: int, overlap: int, count: Callable[[Column], Column]) -> Column:
    """Chunks of a body: one pass per separator over the pieces still too long, then greedy packing of their sizes."""
    whole = F.array(F.struct(body.alias("p"), F.lit(0).alias("k"), F.lit(size).alias("n"), F.lit(True).alias("anew")))
    long = lambda e: (e["n"] >= size) & (e["k"] < F.size(seps))

    def level(found: Column, _: Column) -> Column:
        cut = F.flatten(F.transform(found, lambda e: F.when(long(e), _split_once(e, seps, size, count)).otherwise(F.array(e))))
        return F.when(F.exists(found, long), cut).otherwise(found)

    pieces = F.aggregate(seps, whole, level)

    def packed(x: Column) -> Column:
        spans = T.pack_spans(x["n"], size, overlap, x["anew"], fit=True)
        return F.transform(T.joined(x["p"], spans), T.trim_all)

    # Bound once, so that no step of the packing builds them again.
    return F.filter(F.transform(F.transform(F.array(pieces), _columns), packed)[0], lambda c: c != "")


def chunk_files(
    df: DataFrame,
    body: str = "body",
    size: int = T.CHUNK_TOKENS,
    overlap: int = T.OVERLAP_TOKENS,
    whole: int = T.WHOLE_TOKENS,
    lang: str | None = None,
    count: Callable[[Column], Column] = T.n_tokens,
) -> DataFrame:
    """File bodies split at ever finer separators into rows (chunk_index, chunk).

    Each level is one pass of column expressions over the pieces of a body that
    are still too long; nothing leaves the JVM, nothing is shuffled.  ``lang``
    names a column with the language, whose separators come first; ``count``
    gives the tokens of a text.
    """
    rows = spread_small(df, body)
    short = count(F.col(body)) < whole
    plain = F.array(*[F.lit(s) for s in TEXT_SEPARATORS])
    seps = plain
    if lang:
        lists = F.create_map(*[x for tag, own in CODE_SEPARATORS.items() for x in (F.lit(tag), F.array(*[F.lit(s) for s in own + TEXT_SEPARATORS]))])
        seps = F.coalesce(F.try_element_at(lists, F.col(lang)), plain)
    cut = F.transform(F.array(seps), lambda s: split_body(F.col(body), s, size, overlap, count))[0]
    as_is = rows.filter(short).select(*df.columns, F.lit(0).alias("chunk_index"), F.col(body).alias("chunk"))
    return as_is.unionByName(rows.filter(~short).select(*df.columns, F.posexplode(cut).alias("chunk_index", "chunk")))


def code_chunks(df: DataFrame, path: str = "name", **options) -> DataFrame:
    """File bodies split with the separators of their language, if it has any."""
    return chunk_files(df.withColumn("language", T.language(F.col(path))), lang="language", **options)


# -- conversations and transcripts ---------------------------------------------

def to_prompt(turns: DataFrame) -> DataFrame:
    """``System:``/``User:``/``Assistant:`` blocks of each conversation, in order of ``place``.

    One row per turn and one for the closing label, so a conversation of any
    length is spread over tasks; its prompt is the blocks put together.  Turns
    of other roles or without text have no block.
    """
    label = F.when(F.col("role") == "system", "System: ").when(F.col("role") == "user", "User: ").when(
        F.col("role") == "assistant", "Assistant: "
    )
    blocks = turns.select("conv_id", F.col("turn").cast("long").alias("place"), F.concat(label, F.col("text"), F.lit("\n\n")).alias("block"))
    closing = turns.groupBy("conv_id").agg((F.max("turn") + 1).cast("long").alias("place")).withColumn("block", F.lit("Assistant: "))
    return blocks.filter(F.col("block").isNotNull()).unionByName(closing)


def prompts(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): the blocks of a conversation put together, one text per conversation."""
    blocks = to_prompt(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "block"))).alias("b"))
    return blocks.select("conv_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("prompt"))


def transcripts(segments: DataFrame) -> DataFrame:
    """Trimmed segments in time order (``start_s``), with the length and segment count of their audio."""
    totals = segments.groupBy("audio_id").agg(F.max("end_s").alias("duration_s"), F.count(F.lit(1)).alias("n_segments"))
    rows = segments.select("audio_id", "start_s", T.trim_all(F.col("text")).alias("text"))
    return rows.join(totals, "audio_id")


def transcript_texts(segments: DataFrame) -> DataFrame:
    """One text per audio: its trimmed segments in time order, joined by a space."""
    parts = transcripts(segments).groupBy("audio_id", "duration_s", "n_segments").agg(F.sort_array(F.collect_list(F.struct("start_s", "text"))).alias("s"))
    return parts.select("audio_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), "duration_s", "n_segments")
