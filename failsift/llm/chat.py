"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and its reply is
the only trainable part. A turn is written ``### role:``, line feed, text, ``</turn>``, line
feed. Inside texts and roles the characters of the markers are written as a backslash and a
letter (``ESCAPES``), so that no text can pass for a marker, and unescaping gives back every
text. A conversation that does not end with an assistant turn, or has none, gets
one closing example with all turns and nothing to train on; so the last example of a
conversation holds all its turns.

A conversation is one row while it is formatted, as each example holds its whole context;
the text of a conversation is the unit of memory, and examples are made one by one.

Defined cases: null text or role is empty. Turns go by number (null first), repeated numbers
by role and text, and repeated rows stay. Rows without conv_id form one conversation. Empty
texts of the assistant are examples with an empty trainable part. No rows give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
ASSISTANT = "assistant"
ESCAPES = {"\\": "\\b", "<": "\\l", "#": "\\h", ":": "\\c"}


def escape(text: Column) -> Column:
    for char, written in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """The inverse; the backslash comes last, so that none is read twice."""
    for char, written in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(written), F.lit(char))
    return text


def header(role: Column) -> Column:
    return F.concat(F.lit("### "), escape(role), F.lit(":\n"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (place of its last turn), last, text, loss_start, loss_chars.

    ``loss_start`` is the 0-based place of the trainable part in ``text`` and
    ``loss_chars`` its length, both in code points of the escaped text.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    conversations = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(header(t["role"]), escape(t["text"]), F.lit(END))).alias("pieces"),
        F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("replies"),
        F.transform("turns", lambda t: F.length(header(t["role"]))).alias("heads"),
    )
    count = F.size("pieces")
    places = F.filter(F.sequence(F.lit(1), count), lambda i: F.element_at("replies", i) | (i == count))
    each = conversations.select("*", F.explode(places).alias("example"))
    piece, reply = F.element_at("pieces", F.col("example")), F.element_at("replies", F.col("example"))
    context = F.array_join(F.slice("pieces", 1, F.col("example") - 1), "")
    head = F.element_at("heads", F.col("example"))
    return each.select(
        "conv_id",
        "example",
        (F.col("example") == count).alias("last"),
        F.concat(context, piece).alias("text"),
        F.when(reply, F.length(context) + head).otherwise(F.length(context) + F.length(piece)).alias("loss_start"),
        F.when(reply, F.length(piece) - head - len(END)).otherwise(F.lit(0)).alias("loss_chars"),
    )


def parse(text: Column) -> Column:
    """The (role, text) pairs of a formatted text, in order."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    role = lambda p: F.regexp_extract(p, r"^### ([^:]*):\n", 1)
    body = lambda p: F.regexp_replace(p, r"^### [^:]*:\n", "")
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its examples."""
    target = F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))
    per_conversation = formatted.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("text"))).alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", unescape(target).alias("text")))).alias("targets"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    read = per_conversation.select(
        "conv_id",
        parse(F.col("whole")).alias("turns"),
        F.array_join(F.transform("targets", lambda t: t["text"]), "").alias("loss"),
        "formatted_chars",
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
