"""Chat formatting by event-sourced reconstruction.

A log holds events (conversation, sequence, event, position, role, text):

- ``open`` starts the message at a position (with its text, if any), ``delta`` appends to it;
- ``edit`` replaces the message by its text, ``regenerate`` empties it; either also drops all later
  messages as they stood, as they answered a text that is gone.

The log is partitioned by conversation and sorted by sequence; each event survives unless a later edit
or regeneration hits its position or one before it. What survives is summed to one text per
message and rendered in a ChatML-like template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    r"""Text without control strings: ``\`` is doubled, then ``<|`` becomes ``<\|``.

    Only an odd run of one backslash can then stand between ``<`` and ``|``, so it is reversible.
    """
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As `escape`, and a line end becomes ``<\/``, as a line end closes the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, position, role, text) of a log.

    Input columns: conv_id, seq, event, position, role, text; others are ignored. Events of one conversation
    with the same seq keep the order position, event, text. Null texts are empty; a role is
    the last one that a surviving ``open`` gave (null if none did); a null conv_id is a conversation
    of its own; unknown events and events without a position are ignored. An empty log has no messages.

    One shuffle by conversation serves the sort, the fold and a later rendering.
    """
    order = [F.col("seq"), F.col("position"), F.col("event"), F.col("payload")]
    # Newest first, so that the running minimum looks at later events only and keeps no group in memory.
    newest = Window.partitionBy("conv_id").orderBy(*[c.desc() for c in order])
    resets = F.col("event").isin("edit", "regenerate")
    log = events.filter(F.col("event").isin("open", "delta", "edit", "regenerate") & F.col("position").isNotNull()).select(
        "conv_id", "seq", "event", "position", "role", F.coalesce(F.col("text"), F.lit("")).alias("payload")
    )
    cut = F.min(F.when(resets, F.col("position"))).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    # An opening stands for the position; a reset of that same position keeps it and its role.
    alive = log.withColumn("cut", cut).filter(
        F.col("cut").isNull() | (F.col("position") < F.col("cut")) | ((F.col("position") == F.col("cut")) & (F.col("event") == "open"))
    )
    parts = F.sort_array(F.collect_list(F.struct("seq", "event", "payload")))
    return alive.groupBy("conv_id", "position").agg(
        F.max_by("role", F.when(F.col("event") == "open", F.struct("seq", "payload"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: F.when(p["event"] == "regenerate", F.lit("")).otherwise(p["payload"])), "").alias("text"),
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: formatted text and the loss mask.

    `loss` lists start and length (code points of `formatted`) of each text that is learned from, in
    order. Messages with equal positions go by role, then text. A null role is rendered empty.
    """
    by_position = Window.partitionBy("conv_id").orderBy("position", "role", "text")
    piece = F.concat(F.lit(START), "role_out", F.lit("\n"), "text_out", F.lit(END))
    rows = (
        messages.select(
            "conv_id",
            "position",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .select("conv_id", "position", "role", "text", escape_role(F.col("role")).alias("role_out"), escape(F.col("text")).alias("text_out"))
        .withColumn("piece", piece)
        .withColumn("ends", F.sum(F.length("piece").cast("long")).over(by_position.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank", F.row_number().over(by_position))
    )
    body = F.col("ends") - len(END) - F.length("text_out")
    span = F.when(F.col("role").isin(*loss_roles), F.struct(body.alias("start"), F.length("text_out").cast("long").alias("length")))
    pieces = F.sort_array(F.collect_list(F.struct("rank", "piece", span.alias("span"))))
    return (
        rows.groupBy("conv_id")
        .agg(pieces.alias("pieces"))
        .select(
            "conv_id",
            F.array_join("pieces.piece", "").alias("formatted"),
            F.filter("pieces.span", lambda s: s.isNotNull()).alias("loss"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of each formatted text, and all text under its loss mask, unescaped.

    Adds `turns` (array of role and text) and `loss_text`. Escaped texts hold no control string,
    so the template's own marks are the only places to cut at.
    """
    parts = F.split("formatted", r"<\|im_start\|>")
    cut = F.slice(parts, F.lit(2), F.size(parts) - 1)
    turn = F.transform(
        cut,
        lambda t: F.struct(
            unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(t.substr(F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t) - F.length(F.substring_index(t, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )
    under = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.withColumns({"turns": turn, "loss_text": F.array_join(under, "")})
