"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: a context turn is ``[INST] role LF text [/INST]``, an assistant turn ``<s> text </s>``; an escaped
turn opens with ``[INST%] `` or ``<s%>`` instead. A turn is rendered plainly first and parsed again; if what
comes back differs, its role and text are escaped, which leaves no control string in them and can be
undone. Turns are joined in order and the whole conversation is parsed once more against its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: An end mark closes a turn: the parser cuts after each one.
END_MARK = r"(?<=\[/INST\]|</s>)"
CONTEXT_TURN = r"(?s)^\[INST(%?)\] ([^\n]*)\n(.*)\[/INST\]$"
ANSWER_TURN = r"(?s)^<s(%?)>(.*)</s>$"


def escape(text: Column) -> Column:
    """Text without ``[`` and ``<``, so without control strings, and without line feeds of its own in a role."""
    for plain, code in (("%", "%25"), ("[", "%5B"), ("<", "%3C")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape`` (with line feeds as %0A, where a role had some)."""
    for plain, code in (("<", "%3C"), ("[", "%5B"), ("\n", "%0A"), ("%", "%25")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(role: Column, text: Column, escaped: bool) -> Column:
    """One turn as text."""
    mark = "%" if escaped else ""
    head = F.replace(escape(role), F.lit("\n"), F.lit("%0A")) if escaped else role
    body = escape(text) if escaped else text
    return F.when(role == ASSISTANT, F.concat(F.lit(f"<s{mark}>"), body, F.lit("</s>"))).otherwise(F.concat(F.lit(f"[INST{mark}] "), head, F.lit("\n"), body, F.lit("[/INST]")))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text: array of (role, text, body), ``body`` still escaped. A piece that is no turn has null fields."""

    def turn(piece: Column) -> Column:
        answer = piece.startswith("<s")
        pattern = lambda p, k: F.regexp_extract(piece, p, k)
        known = piece.rlike(ANSWER_TURN) | piece.rlike(CONTEXT_TURN)
        body = F.when(answer, pattern(ANSWER_TURN, 2)).otherwise(pattern(CONTEXT_TURN, 3))
        coded = F.when(answer, pattern(ANSWER_TURN, 1)).otherwise(pattern(CONTEXT_TURN, 1)) == "%"
        head = pattern(CONTEXT_TURN, 2)
        role = F.when(answer, F.lit(ASSISTANT)).otherwise(F.when(coded, unescape(head)).otherwise(head))
        return F.struct(
            F.when(known, role).alias("role"),
            F.when(known, F.when(coded, unescape(body)).otherwise(body)).alias("text"),
            F.when(known, body).alias("body"),
        )

    return F.transform(F.filter(F.split(rendered, END_MARK), lambda p: p != ""), turn)


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each row's turn rendered so that it parses back to itself alone: conv, turn, role, text, rendered, escaped."""
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.withColumn("plain", render(F.col("role"), F.col("text"), False))
    rows = rows.withColumn("back", parse(F.col("plain")))
    first = F.get("back", F.lit(0))
    same = (F.size("back") == 1) & first["role"].eqNullSafe(F.col("role")) & first["text"].eqNullSafe(F.col("text"))
    rows = rows.withColumn("escaped", ~same)
    return rows.select("conv", "turn", "role", "text", F.when(F.col("escaped"), render(F.col("role"), F.col("text"), True)).otherwise(F.col("plain")).alias("rendered"), "escaped")


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text of ``formatted`` under ``spans`` (start, length), joined; unescaped where the mark before a span is ``<s%>``."""
    at = lambda start, n: F.substr(formatted, (start + 1).cast("int"), n.cast("int"))

    def one(span: Column) -> Column:
        body = at(span["start"], span["length"])
        return F.when(at(span["start"] - 2, F.lit(1)) == "%", unescape(body)).otherwise(body)

    return F.array_join(F.transform(spans, one), "")


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted``, ``turns`` (role, text; parsed from ``formatted``), ``loss_spans``
    (start and length in code points of ``formatted``, one for each assistant turn's body) and ``loss_text`` (what ``formatted`` has there, unescaped, joined).

    Turns stand in order of (turn, role, text), nulls first; a null role or text counts as empty, rows with a
    null conversation form one conversation, repeated rows are repeated turns. An empty table gives an
    empty table. Other columns are not read and may have any names. A conversation is one row, however long. The query fails if a conversation does not parse back to its source, which ``escape`` rules out.
    """
    turns = format_turns(conversations, conv_col, turn_col, role_col, text_col)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    size = F.length("rendered").cast("long")
    before = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    one = F.struct(F.row_number().over(order).alias("at"), "role", "text", "rendered", before.alias("start"))
    whole = turns.select("conv", one.alias("one")).groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("source"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["rendered"]), ""))
    whole = whole.withColumn("parsed", parse(F.col("formatted")))
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    identical = plain("source").eqNullSafe(plain("parsed"))
    whole = whole.withColumn("turns", F.when(identical, plain("parsed")).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns"))))
    opening = lambda t: F.when(t["rendered"].startswith("<s%>"), 4).otherwise(3)
    span = lambda t: F.struct((t["start"] + opening(t)).alias("start"), (F.length(t["rendered"]) - opening(t) - 4).cast("long").alias("length"))
    answers = lambda c: F.filter(c, lambda t: t["role"] == ASSISTANT)
    whole = whole.withColumn("loss_spans", F.transform(answers("source"), span))
    return whole.select(F.col("conv").alias(conv_col), "formatted", "turns", "loss_spans", under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss_text"))
