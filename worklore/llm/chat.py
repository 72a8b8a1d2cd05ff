"""Chat formatting with a prefix tree: shared initial turns are written once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  In a text, ``<``,
any number of backslashes and ``|`` get one more backslash, so no text holds a
control string and unescaping is exact; in a role, backslashes and line feeds
are escaped as well.  A token is a code point.

1. A turn's node in the tree is named by a running exclusive-or over its
   conversation of hashes of (place, role, text): equal names, equal prefixes.
2. A node with several children is a branching.  A conversation's way through
   branchings, and its length, put all conversations in an order in which those
   with a common prefix stand together, which is the tree's depth-first order.
   The i-th branching on a way needs another conversation of i turns, so a way
   has at most sqrt(2 * rows) of them and fits in a row.
3. A node belongs to the first conversation that has it.  What a conversation
   adds is its segment, one stretch of its tree's token sequence; where it
   starts is a running sum over the segments before it.
4. Position ids go on along the way from the root, not along the sequence.  A
   token attends to its segment up to itself and to the stretches of its
   ancestors, given as intervals of the sequence.

Trees, nodes, and conversations may be of any size: nothing but ways and
intervals is ever gathered in a row, and joins deal out keys that more than a
thousandth of the rows have.  Reading a conversation back as a whole puts its
text in one row.

Defined cases: turns go by turn (null first), then role, then text hash;
repeated rows are turns of their own; null roles and texts are empty; rows with
a null id are one conversation; a conversation may be a prefix or a copy of
another and then adds nothing; empty tables give empty tables; other columns
are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.llm.common import materialize
from worklore.operators.spread import running

START, END = "<|im_start|>", "<|im_end|>"
#: Roles whose texts are learned.
LEARNED = ("assistant",)
#: Parts that a hot key of a join is dealt over; a key is hot above this share of the rows.
SALTS, HOT_SHARE = 32, 1000
NODE = ["k1", "k2"]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table that has a key once; keys that many rows of ``left`` have are dealt out.

    At most ``HOT_SHARE`` keys can be hot, so their table is broadcast.
    """
    limit = left.count() // HOT_SHARE
    hot = materialize(left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*on, F.lit(SALTS).alias("_parts")), "hot")
    parts = F.coalesce("_parts", F.lit(1))
    any_row = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), parts)
    left = left.join(F.broadcast(hot), on, "left").withColumn("_part", any_row.cast("int")).drop("_parts")
    right = right.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


@dataclass
class Packed:
    """The packed form of conversations.

    ``nodes``: (tree, segment, place, start, end, position, role, value,
    loss_start, loss_end) per node, ``value`` its formatted turn, whose tokens
    have sequence numbers ``start`` to ``end`` in their tree and position ids
    from ``position``; the loss mask is a range of sequence numbers, null for
    roles that are not learned.
    ``segments``: (tree, segment, start, end, position, ancestors) per segment;
    its tokens attend to all of ``ancestors`` and to the segment up to themselves.
    ``members``: (conv_id, tree, n_turns, n_tokens, spans) per conversation; the
    spans, in order, are its own stretches of the sequence.
    """

    nodes: DataFrame
    segments: DataFrame
    members: DataFrame

    def write(self, path: str) -> None:
        for name in ("nodes", "segments", "members"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Packed:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "segments", "members")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, role, text, turn, h1, h2, row): ``c`` holds the id so that a null id is a key like others.

    Written, so that the row numbers stay what they are.
    """
    rows = conversations.select(
        F.struct(F.col("conv_id").cast("long").alias("id")).alias("c"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    code = F.sha2("text", 256)
    number = lambda at: F.conv(F.substring(code, at, 15), 16, 10).cast("long")
    return materialize(rows.withColumns({"h1": number(1), "h2": number(16), "row": F.monotonically_increasing_id()}), "turns")


def placed(rows: DataFrame) -> DataFrame:
    """Turns without their texts: place in the conversation, tokens up to their end, node and parent names."""
    size = F.char_length(formatted(F.col("role"), F.col("text"))).cast("long")
    narrow = rows.select("c", "turn", "role", "h1", "h2", size.alias("size"), "row")
    order = [F.col(x) for x in ("turn", "role", "h1", "h2", "row")]
    counted = running(narrow, ["c"], order, place=("sum", F.lit(1).cast("long")), upto=("sum", F.col("size"))).drop("turn")
    one = F.xxhash64("place", "role", "h1", "h2")
    two = F.xxhash64("h2", "h1", "role", "place")
    named = running(counted, ["c"], [F.col("place")], k1=("xor", one), k2=("xor", two))
    return named.withColumns({"p1": F.col("k1").bitwiseXOR(one), "p2": F.col("k2").bitwiseXOR(two)})


def ordered(turns: DataFrame) -> DataFrame:
    """(c, rank, tree, n_turns, n_tokens) per conversation, ranks in depth-first order of the trees."""
    nodes = turns.groupBy(*NODE).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("place").alias("place"))
    inner = materialize(nodes.where("place > 1"), "inner")
    several = inner.groupBy("p1", "p2").count().where("count > 1").select("p1", "p2")
    branches = hot_join(inner, several, ["p1", "p2"]).select(*NODE, F.lit(True).alias("branch"))
    marked = hot_join(turns.select("c", "place", "upto", *NODE), branches, NODE, "left")
    step = F.when((F.col("place") == 1) | F.col("branch"), F.struct("place", *NODE))
    ways = marked.groupBy("c").agg(F.sort_array(F.collect_list(step)).alias("way"), F.max("place").alias("n_turns"), F.max("upto").alias("n_tokens"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["way", "n_turns", "c"]
    ranked = ways.repartitionByRange(n, *order).sortWithinPartitions(*order)
    root = F.get("way", F.lit(0))
    tree = F.lower(F.concat(*[F.lpad(F.hex(root[k]), 16, "0") for k in NODE]))
    return ranked.select("c", F.monotonically_increasing_id().alias("rank"), tree.alias("tree"), "n_turns", "n_tokens")


def pack(conversations: DataFrame) -> Packed:
    """All conversations as prefix trees; see ``Packed``."""
    rows = turns_of(conversations)
    turns = materialize(placed(rows), "places")
    convs = materialize(ordered(turns), "conversations")
    ranked = materialize(hot_join(turns.drop("p1", "p2"), convs.select("c", "rank"), ["c"]), "ranked")
    owners = ranked.groupBy(*NODE).agg(F.min("rank").alias("segment"))
    owned = materialize(hot_join(ranked, owners, NODE).drop(*NODE), "owned")

    own = owned.where("segment = rank")
    added = own.groupBy("segment").agg(F.sum("size").alias("size"), F.min(F.col("upto") - F.col("size")).alias("position"))
    added = added.join(convs.select(F.col("rank").alias("segment"), "tree"), "segment")
    starts = running(added, ["tree"], [F.col("segment")], end=("sum", F.col("size")))
    starts = materialize(starts.select("tree", "segment", (F.col("end") - F.col("size")).alias("start"), "end", "position"), "starts")

    # A node's sequence number is its position moved by what is constant in a segment.
    moved = starts.select("segment", (F.col("start") - F.col("position")).alias("shift"))
    stretches = owned.groupBy("c", "rank", "segment").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.min(F.col("upto") - F.col("size")).alias("from"), F.max("upto").alias("to")
    )
    span = F.struct("first", "last", "segment", (F.col("from") + F.col("shift")).alias("start"), (F.col("to") + F.col("shift")).alias("end"))
    spans = hot_join(stretches, moved, ["segment"]).groupBy("c", "rank").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    members = convs.join(spans, ["c", "rank"]).select(F.col("c.id").alias("conv_id"), "rank", "tree", "n_turns", "n_tokens", "spans")

    before = F.filter("spans", lambda s: s["segment"] != F.col("segment"))
    ways = members.select(F.col("rank").alias("segment"), "spans")
    segments = starts.join(ways, "segment").select("tree", "segment", "start", "end", "position", F.transform(before, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("ancestors"))

    # Texts meet the nodes last, and once, by row number.
    moves = starts.select("segment", "tree", (F.col("start") - F.col("position")).alias("shift"))
    whole = hot_join(own.select("row", "segment", "place", "role", "size", "upto"), moves, ["segment"]).join(rows.select("row", "text"), "row")
    start = F.col("upto") - F.col("size") + F.col("shift")
    tail = len(END) + 1
    learned = F.col("role").isin(*LEARNED)
    nodes = whole.select(
        "tree", "segment", "place", start.alias("start"), (F.col("upto") + F.col("shift")).alias("end"), (F.col("upto") - F.col("size")).alias("position"),
        "role", formatted(F.col("role"), F.col("text")).alias("value"),
        F.when(learned, start + len(START) + F.char_length(escape_role(F.col("role"))) + 1).alias("loss_start"),
        F.when(learned, F.col("upto") + F.col("shift") - tail).alias("loss_end"),
    )
    return Packed(nodes, segments, members.drop("rank"))


def unpack(packed: Packed) -> DataFrame:
    """(conv_id, place, value, learned) per turn of every conversation, from the packed form.

    ``learned`` is the text under the loss mask, null without one.
    """
    spans = packed.members.select(F.struct(F.col("conv_id").alias("id")).alias("c"), F.explode("spans").alias("s"))
    steps = spans.select("c", F.col("s.segment").alias("segment"), F.explode(F.sequence("s.first", "s.last")).alias("place"))
    masked = F.substr(F.col("value"), (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    nodes = packed.nodes.select("segment", "place", "value", masked.alias("learned"))
    return hot_join(materialize(steps, "steps"), nodes, ["segment", "place"]).select(F.col("c.id").alias("conv_id"), "place", "value", "learned")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text says when it is read again."""
    part = F.struct("place", "value", "learned")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "")
    learned = F.array_join(F.transform(F.filter("parts", lambda p: p["learned"].isNotNull()), lambda p: unescape(p["learned"])), "")
    whole = whole.select("conv_id", text.alias("text"), learned.alias("learned"))
    # Every turn ends in a control string that no text holds.
    blocks = F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def again(block: Column) -> Column:
        inside = F.substr(block, F.lit(len(START) + 1))
        cut = F.instr(inside, "\n")
        return F.concat(unescape_role(F.substr(inside, F.lit(1), cut - 1)), F.lit("\n"), unescape(F.substr(inside, cut + 1)), F.lit("\n"))

    read = whole.withColumns({"blocks": blocks})
    return read.select(
        "conv_id",
        F.size("blocks").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("blocks", again), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )
