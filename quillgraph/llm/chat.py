"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output (one string per conversation)::

    conversation := turn*
    turn         := "### " role ": " text "</turn>\\n"

The parser cuts at ``</turn>\\n``, takes the role up to the first ``": "`` and
undoes escapes. A control string is escaped by one backslash put inside it
(``<\\/turn>``, ``#\\## ``, ``:\\ `` in roles); where backslashes already stand
there, one more is added, so that undoing is exact at any depth. Every turn is
first rendered as it is and parsed again; only turns whose role or text do not
come back identical are rendered with escapes, and those are parsed and
compared again (a turn that still differed would stop the job).

Defined cases: a null text or role counts as empty; rows are ordered by
(turn, role, text) with nulls first, so ties and repeated rows keep one
order; a null ``conv_id`` is a conversation of its own; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
HEAD = "### "
SEP = ": "


def _escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>")
    return F.regexp_replace(text, r"#(\\*)## ", r"#\\$1## ")


def _unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)/turn>", r"<$1/turn>")
    return F.regexp_replace(text, r"#\\(\\*)## ", r"#$1## ")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(_escape(role), r":(\\*) ", r":\\$1 ")


def _unescape_role(role: Column) -> Column:
    return _unescape(F.regexp_replace(role, r":\\(\\*) ", r":$1 "))


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(SEP), text, F.lit(END))


def parse_piece(piece: Column) -> Column:
    """struct(role, text, start): what one piece between two ends holds; start counts the head's code points."""
    body = F.substring(piece, len(HEAD) + 1, 2147483647)
    role = F.substring_index(body, SEP, 1)
    start = F.length(role) + F.lit(len(HEAD) + len(SEP))
    text = piece.substr(start + 1, F.length(piece))
    return F.struct(_unescape_role(role).alias("role"), _unescape(text).alias("text"), start.alias("start"))


def pieces(formatted: Column) -> Column:
    """The deterministic parser's cut; what follows the last end is empty and dropped."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    """Whether the parser gets exactly this one turn back."""
    cut = pieces(rendered)
    one = parse_piece(F.coalesce(F.get(cut, 0), F.lit("")))
    return (F.size(cut) == 1) & (one["role"] == role) & (one["text"] == text)


def format_conversations(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` is the loss mask: an array of (turn_index, start, length) in
    code points of the turn's own piece of ``formatted``, for the texts that
    the loss covers. A conversation is one string by definition, so its turns
    meet in one row; nothing else of the table does.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    raw = _render(F.col("role"), F.col("text"))
    safe_role, safe_text = _escape_role(F.col("role")), _escape(F.col("text"))
    turns = turns.withColumn("plain", _same(raw, F.col("role"), F.col("text")))
    turns = turns.withColumn("o_role", F.when(F.col("plain"), F.col("role")).otherwise(safe_role))
    turns = turns.withColumn("o_text", F.when(F.col("plain"), F.col("text")).otherwise(safe_text))
    again = _same(_render(F.col("o_role"), F.col("o_text")), F.col("role"), F.col("text"))
    checked = F.when(F.col("plain") | again, F.col("o_text")).otherwise(
        F.raise_error(F.lit("a turn did not survive the round trip")).cast("string")
    )
    turns = turns.select("conv_id", F.struct("turn", "role", "text", "o_role", checked.alias("o_text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda t: _render(t["o_role"], t["o_text"])), "")
    spans = F.filter(
        F.transform(
            "ts",
            lambda t, i: F.struct(
                i.alias("turn_index"),
                (F.length(t["o_role"]) + len(HEAD) + len(SEP)).alias("start"),
                F.length(t["o_text"]).alias("length"),
                t["role"].isin(*loss_roles).alias("loss"),
            ),
        ),
        lambda s: s["loss"],
    )
    return grouped.select(
        "conv_id",
        formatted.alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["turn_index"], s["start"], s["length"])).alias("loss_spans"),
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Read conversations back: conv_id, formatted, turns (role, text), loss_texts (unescaped, in order)."""
    cut = formatted.withColumn("cut", pieces(F.col("formatted")))
    return cut.select(
        "conv_id",
        "formatted",
        F.transform("cut", lambda p: _turn_of(p)).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: _unescape(F.element_at(F.col("cut"), s["turn_index"] + 1).substr(s["start"] + 1, s["length"])),
        ).alias("loss_texts"),
    )


def _turn_of(piece: Column) -> Column:
    turn = parse_piece(piece)
    return F.struct(turn["role"].alias("role"), turn["text"].alias("text"))
