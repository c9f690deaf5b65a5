"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. The parser splits on those marks and always unescapes.
A rendering must hold each mark once: a turn whose own rendering does not, or does not parse back to itself, is escaped: a backslash goes into every ``<|`` (and one more
into ``<\\|``, ``<\\\\|`` ...), which removes all control strings and is undone exactly by taking one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BETWEEN = r"\Q" + CLOSE + OPEN + r"\E"


def escape(text: Column) -> Column:
    """``<|`` becomes ``<\\|``; any backslashes between < and | get one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Takes one backslash from every ``<\\|``, ``<\\\\|`` ...: the inverse of escape()."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at the first line feed, so line feeds and backslashes in it are written as two characters: \\n and \\b."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """The inverse of escape_role(): what was a backslash is followed by b, so one before n was a line feed."""
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text); deterministic, no knowledge of the source."""
    body = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(piece, F.length(role) + 2, F.length(piece))).alias("text"))

    return F.transform(F.split(body, BETWEEN), turn)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def chat_format(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: the formatted text, the loss mask and what the parser reads back.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. Null role and text are empty, rows with a
    null conv_id form one conversation, null turns come first, rows of one turn are ordered by role and text, repeated
    rows are turns of their own. Columns: conv_id, formatted, spans (array of start and length, in code points from 0,
    of each assistant text as it stands in ``formatted``), parsed (array of role and text), n_escaped, round_trip
    (whether the turns read back equal the source).
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lone = F.get(parse(render(F.col("role"), F.col("text"))), F.lit(0))
    one = F.regexp_count(render(F.col("role"), F.col("text")), F.lit(r"<\|im_(?:start|end)\|>")) == 2
    safe = one & (lone["role"] == F.col("role")) & (lone["text"] == F.col("text"))
    rows = rows.withColumn("safe", safe).select(
        "conv_id", "turn", "role", "text", "safe",
        F.when(F.col("safe"), F.col("role")).otherwise(escape_role(F.col("role"))).alias("as_role"),
        F.when(F.col("safe"), F.col("text")).otherwise(escape(F.col("text"))).alias("as_text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), "role", "text", "safe", "as_role", "as_text")
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "safe", "as_role", "as_text"))).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["safe"].alias("safe"), t["as_role"].alias("as_role"), t["as_text"].alias("as_text")))
    escaped = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.lit(False).alias("safe"), escape_role(t["role"]).alias("as_role"), escape(t["text"]).alias("as_text")))
    joined = lambda turns: F.array_join(F.transform(turns, lambda t: render(t["as_role"], t["as_text"])), "")
    # turns that read back alone may not do so beside each other: then all of the conversation's turns are escaped
    once = whole.select("conv_id", source.alias("source"), "turns", plain.alias("plain"))
    turns = once.select("conv_id", "source", F.when(parse(joined("plain")) == F.col("source"), F.col("plain")).otherwise(escaped).alias("turns"))
    formatted = turns.select("conv_id", "source", "turns", joined("turns").alias("formatted"), starts(F.col("turns")).alias("starts"))
    spans = F.filter(
        F.transform("turns", lambda t, i: F.struct(F.get("starts", i).alias("start"), F.length(t["as_text"]).cast("long").alias("length"), t["role"].alias("role"))), lambda s: s["role"] == "assistant"
    )
    return formatted.withColumn("parsed", parse(F.col("formatted"))).select(
        "conv_id", "formatted", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("spans"), "parsed",
        F.size(F.filter("turns", lambda t: ~t["safe"])).alias("n_escaped"), (F.col("parsed") == F.col("source")).alias("round_trip"),
    )


def starts(turns: Column) -> Column:
    """Where the text of each turn begins, in code points: sums of what stands before it, in one pass."""
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.expr("cast(array() as array<bigint>)").alias("at"))

    def step(a: Column, t: Column) -> Column:
        first = a["end"] + len(OPEN) + F.length(t["as_role"]) + 1
        return F.struct((first + F.length(t["as_text"]) + len(CLOSE)).cast("long").alias("end"), F.concat(a["at"], F.array(first.cast("long"))).alias("at"))

    return F.aggregate(turns, empty, step, lambda a: a["at"])


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    pieces = F.transform(F.array(F.struct(formatted.alias("f"), spans.alias("s"))), lambda x: F.transform(x["s"], lambda p: unescape(F.substring(x["f"], (p["start"] + 1).cast("int"), p["length"].cast("int")))))
    return F.array_join(F.get(pieces, F.lit(0)), "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of chat_format()'s result, all read back from ``formatted``."""
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = formatted.withColumn("loss", masked_text(F.col("formatted"), F.col("spans")))
    return loss.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
