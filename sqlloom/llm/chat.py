"""Conversations as one training text, checked by reading them back (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import once

# fixed values of the template
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

# A control opening is "<", any number of backslashes, "|".  Escaping adds one backslash and
# unescaping takes one away, so an escaped text holds no "<|" and both directions are exact.
_OPENING, _ADDED = r"<(\\*)\|", r"<$1\\|"
_ESCAPED, _REMOVED = r"<(\\*)\\\|", r"<$1|"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, _OPENING, _ADDED)


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, _REMOVED)


def escape_role(c: Column) -> Column:
    """A role ends at the first line break, so its own breaks are written as %0A and its percent signs as %25."""
    return F.replace(F.replace(escape_text(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _body_start(role: Column) -> Column:
    return F.char_length(role) + len(START) + 1


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Code-point places [start, end) of the text that carries loss."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + _body_start(t["role"])
        end = start + F.char_length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"),
                        F.when(t["role"] == LOSS_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def parse(formatted: Column) -> Column:
    """The turns of a formatted text by its grammar, texts and roles unescaped.

    ``output := turn*``, ``turn := START role LF text END LF``.  The text is cut at END LF; the
    part after the last cut must be empty and every other part must begin with START, hold
    a line break and, behind START, no further control opening "<|".  What breaks a rule becomes a
    null turn, which equals no source turn.
    """
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    rest = F.element_at(parts, -1)

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(START) + 1), F.char_length(p))
        cut = F.instr(body, "\n")
        return F.when(p.startswith(START) & (cut > 0) & ~F.contains(body, F.lit("<|")), F.struct(
            unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape_text(F.substring(body, cut + 1, F.char_length(body))).alias("text")))

    turns = F.transform(whole, turn)
    broken = F.lit(None).cast("struct<role:string,text:string>")
    return F.when(rest == "", turns).otherwise(F.concat(turns, F.array(broken)))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One formatted text per conversation, with the places under the loss mask.

    Rendering is tried as it is; the text is parsed again and compared with the source, and a
    conversation that does not come back is rendered with its control strings escaped, then compared
    once more.  Columns: ``conv_id``, ``formatted``, ``loss_mask`` (code-point spans of the assistant texts as
    they stand in ``formatted``), ``escaped`` (whether escaping was needed), ``identical``
    (whether the parsed turns equal the source; always true).

    Rows are ordered by turn, ties and null turns (first) by role and text, so repeated rows are
    repeated turns.  Null role or text is empty; a null ``conv_id`` is a conversation of its own; extra
    columns are ignored; an empty table gives an empty result.  A conversation is one output row, so it is
    gathered in one task; there is no other way to write or hash it.
    """
    turns = conversations.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_t"))
    source = once(gathered, _source=F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    raw = once(source, _raw=_render(F.col("_source")))
    tried = once(raw, _ok=F.coalesce(parse(F.col("_raw")) == F.col("_source"), F.lit(False)))
    written = F.when(F.col("_ok"), F.col("_source")).otherwise(F.transform("_source", lambda t: F.struct(
        escape_role(t["role"]).alias("role"), escape_text(t["text"]).alias("text"))))
    final = once(once(tried, _written=written), formatted=_render(F.col("_written")), loss_mask=_mask(F.col("_written")))
    return final.select("conv_id", "formatted", "loss_mask", (~F.col("_ok")).alias("escaped"),
                        (parse(F.col("formatted")) == F.col("_source")).alias("identical"))


def loss_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the mask, nothing between its parts."""
    return F.array_join(F.transform(mask, lambda m: unescape_text(
        F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
