r"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has events (conversation, sequence, message position, kind, role, text). Kinds:

* ``message``: the message's whole text; ``delta``: text streamed to the end of what the message has;
* ``edit`` and ``regenerate``: the text so far is replaced; deltas after it go on from there;
* ``delete``: the message goes, unless a later event of another kind brings it back.

A message's events are folded in the order of sequence; then a conversation's messages are sorted by position and
rendered. A conversation is the unit of output, so its messages meet in one row; its events don't: they're combined by
message before.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside texts ``\`` becomes ``\\`` and ``<|`` becomes
``<\|``, so no marker can come from a text, and the change can be undone exactly. In roles a newline becomes ``<\/|`` too.

Defined cases: null text and null role are empty; a null kind is a message; null positions come first; equal sequence
numbers are folded by text order; a repeated event counts as an event of its own; null conversation ids are one
conversation; an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\/|"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\/|"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, turn, kind, role, text) to final messages (conv_id, turn, role, text)."""
    e = events.select("conv_id", "turn", F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e"))
    m = e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("es"))
    gone = F.lit(None).cast("string")
    text = F.aggregate(
        "es",
        gone,
        lambda acc, x: F.when(x["kind"] == "delta", F.concat(F.coalesce(acc, F.lit("")), x["text"])).when(x["kind"] == "delete", gone).otherwise(x["text"]),
    )
    return m.select("conv_id", "turn", F.element_at("es", -1)["role"].alias("role"), text.alias("text")).where("text is not null")


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages (conv_id, turn, role, text) to one row per conversation: conv_id, formatted, loss_spans.

    loss_spans: (start, length) in code points of the formatted text, one for each message of a role to be learned.
    """
    body = F.struct("turn", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"))
    c = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(body)).alias("ms"))
    pieces = c.select("conv_id", F.transform("ms", lambda m: F.struct(F.concat(F.lit(START), m["role"], F.lit("\n")).alias("head"), m["text"].alias("text"), m["loss"].alias("loss"))).alias("ps"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.struct(start.cast("long").alias("start"), F.length(p["text"]).cast("long").alias("length"))
        return F.struct((start + F.length(p["text"]) + len(END)).cast("long").alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
        F.aggregate("ps", zero, step)["spans"].alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The formatted text read back: an array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(START) + 1), F.length(p))
        cut = F.locate("\n", rest)
        return F.struct(unescape_role(F.substring(rest, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(rest, cut + 1, F.length(rest))).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
