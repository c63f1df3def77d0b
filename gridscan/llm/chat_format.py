"""Chat formatting from an event log, with DataFrame functions only.

A log holds one row per event: conv_id, seq, turn, kind, role, text. Events of a turn are folded in the
order of seq (ties: kind, role, text):

* ``delta`` appends to the message;
* ``edit`` replaces what the message holds;
* ``regenerate`` empties it, so that the deltas that follow are a new answer;
* any other kind, or none, starts a message of its own. A turn that repeats is therefore two messages.

Messages are ordered by turn (null first), then by their number in the turn, and rendered as one text per
conversation. Defined cases: null role or text is empty; a null conv_id is a conversation of its own; an
empty log gives no rows; a conversation whose rows repeat has each of them; further columns are ignored.

The fold needs no sequential state: what remains of a message is the text since its last edit or
regeneration, which a running count finds. Events are dealt by (conv_id, turn), so that long streams of
deltas in a large conversation spread over tasks, and only finished messages meet per conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS_OF_A_MESSAGE = ("delta", "edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """How a turn is rendered: start, role, separator, text, end.

    Inside roles and texts the control strings are broken up by a backslash, and backslashes are doubled,
    so every rendered conversation can be read back exactly.
    """

    start: str = "### "
    separator: str = ":\n"
    end: str = "</turn>\n"
    learned_role: str = "assistant"


DEFAULT = Template()


def escape(text: Column) -> Column:
    """Break up '##' and '</turn>'; no run of three '#' and no end mark is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":\n"), F.lit(":\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text: the final messages of a log."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rows = events.select(
        "conv_id",
        "turn",
        "seq",
        kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    in_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (~F.col("kind").isin(*KINDS_OF_A_MESSAGE)).cast("long")
    resets = (F.col("kind") != "delta").cast("long")
    rows = rows.select(
        "*",
        F.row_number().over(in_turn).alias("place"),
        F.sum(starts).over(so_far).alias("message"),
        F.sum(resets).over(so_far).alias("version"),
    )
    whole = Window.partitionBy("conv_id", "turn", "message")
    rows = rows.select(
        "*",
        F.max("version").over(whole).alias("last_version"),
        F.min_by("role", F.when(F.col("role") != "", F.col("place"))).over(whole).alias("message_role"),
    ).where(F.col("version") == F.col("last_version"))
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return rows.groupBy("conv_id", "turn", "message").agg(
        F.coalesce(F.max("message_role"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, loss_spans: one text per conversation and where a model learns from it.

    A span is (start, end) in code points of ``formatted``, end exclusive, around the text of a message
    of the learned role.
    """
    head = F.concat(F.lit(template.start), escape_role(F.col("role")), F.lit(template.separator))
    body = escape(F.col("text"))
    rows = messages.select(
        "conv_id",
        "turn",
        "message",
        F.length(head).cast("long").alias("head_chars"),
        F.length(body).cast("long").alias("body_chars"),
        F.concat(head, body, F.lit(template.end)).alias("rendered"),
        (F.col("role") == template.learned_role).alias("learned"),
    )
    before = (
        Window.partitionBy("conv_id")
        .orderBy("turn", "message")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).cast("long")
    rows = rows.select("*", start.alias("start"))
    first = F.col("start") + F.col("head_chars")
    span = F.struct(first.alias("start"), (first + F.col("body_chars")).alias("end"))
    turns = F.array_sort(F.collect_list(F.struct("start", "rendered")))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda t: t["rendered"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learned"), span))).alias("loss_spans"),
    )


def format_conversations(events: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Fold a log into messages and render every conversation."""
    return render(fold_messages(events), template)


def parse_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> read back from a rendered conversation."""
    pieces = F.split(formatted, template.end, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        piece = F.substr(piece, F.lit(len(template.start) + 1))
        role = F.substring_index(piece, template.separator, 1)
        text = F.substr(piece, F.length(role) + F.lit(len(template.separator) + 1))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.transform(
        spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return F.array_join(parts, "")


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A log in which every row of conv_id, turn, role, text is a whole message."""
    return conversations.select(
        "conv_id",
        F.lit(0).cast("long").alias("seq"),
        "turn",
        F.lit("message").alias("kind"),
        "role",
        "text",
    )
