"""Chat formatting with a grammar round trip, by DataFrame functions only.

    conversation := turn*
    turn         := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

A text or role that holds a control string would be read as something else. Each turn
is therefore rendered, read by the parser and compared with its source; where they
differ, its content is escaped and the turn is read again. Escaping puts one more
backslash after the "<" of every control string, escaped or not, and reading takes
one away, so the escaped turn always reads as its source.

Defined cases: a null text is empty, a null role is an empty role; turns of a
conversation are ordered by turn, then role, then text; repeated rows are repeated
turns; a null conversation id is one conversation; other columns are not read; an
empty table has no conversations. A conversation of any length is one row, as its
digest is one number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_(start|end)\|>", r"<$1|im_$2|>")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def split_turns(formatted: Column) -> Column:
    """The turns of a formatted text without their end marks; an end mark ends a turn wherever it stands."""
    return F.filter(F.split(formatted, r"<\|im_end\|>\n?"), lambda t: t != "")


def parse_turn(turn: Column) -> Column:
    """(role, text) of a turn without its end mark, or null if it is none."""
    body = F.substring(turn, len(START) + 1, 2**31 - 1)
    at = F.instr(body, "\n")
    good = turn.startswith(START) & (at > 0) & ~body.contains(START)
    return F.when(good, F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
                                 unescape(F.substring(body, at + 1, F.length(body))).alias("text")))


def reads_back(rendered: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn is read as exactly this turn."""
    turns = split_turns(rendered)
    got = parse_turn(F.get(turns, F.lit(0)))
    return (F.size(turns) == 1) & F.coalesce((got["role"] == role) & (got["text"] == text), F.lit(False))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, mask, identical): one row for each conversation.

    ``mask`` has for each turn its length and the loss span in it, in code points
    (``skip`` points, then ``take`` points that carry loss; none for other roles).
    ``identical`` tells that every turn was read back as its source.
    """
    turns = rows.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    plain, safe = render(F.col("r"), F.col("x")), render(escape_role(F.col("r")), escape(F.col("x")))
    turns = turns.withColumn("safe", F.when(reads_back(plain, F.col("r"), F.col("x")), plain).otherwise(safe))
    turns = turns.withColumn("ok", reads_back(F.col("safe"), F.col("r"), F.col("x")))
    skip = F.instr("safe", "\n")
    take = F.when(F.col("r") == LOSS_ROLE, F.length("safe") - skip - len(END) - 1).otherwise(0)
    mask = F.struct(F.length("safe").alias("length"), skip.alias("skip"), take.alias("take"))
    grouped = turns.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x", "safe", mask.alias("mask")))).alias("all"), F.bool_and("ok").alias("identical"))
    return grouped.select(F.col("c").alias(conv), F.array_join(F.transform("all", lambda x: x["safe"]), "").alias("formatted"),
                          F.transform("all", lambda x: x["mask"]).alias("mask"), "identical")


def parse_chats(formatted: DataFrame, column: str = "formatted", name: str = "turns") -> DataFrame:
    """Adds the turns read from a formatted text: an array of (role, text)."""
    return formatted.withColumn(name, F.transform(split_turns(F.col(column)), parse_turn))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    turns = F.arrays_zip(split_turns(formatted).alias("turn"), mask.alias("span"))
    return F.array_join(F.transform(F.filter(turns, lambda x: x["span"]["take"] > 0),
                                    lambda x: unescape(F.substring(x["turn"], x["span"]["skip"] + 1, x["span"]["take"]))), "")
