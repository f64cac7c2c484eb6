"""Conversations rebuilt from their event logs and rendered for training.

Events of a conversation are ordered by ``seq``. ``delta`` appends to a message, ``edit`` replaces its text,
``regenerate`` empties it (its later deltas are the new answer), ``delete`` removes it until a later event writes to it
again. A message keeps the place of its first event and the role its last event with a role names.
Everything is DataFrame functions: a message is folded from the events after its last reset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings. A text never holds "<" after escaping, so none of them can be forged.
TURN, BODY, END = "<turn>", "<text>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, place, role, text) of every message that is left.

    ``events`` has conv_id, seq, message_id, kind, role and text. Null texts are empty, a null kind is a delta, rows
    without seq come first; equal seqs are ordered by message, kind and text, so equal input gives equal output.
    Events equal in all these columns are one event delivered twice and count once.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    rows = events.select("conv_id", "message_id", "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    event = F.struct("seq", "kind", "text", "role")
    log = rows.groupBy("conv_id", "message_id").agg(
        F.array_sort(F.array_distinct(F.collect_list(event))).alias("log"), F.min("seq").alias("place"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i + 1).otherwise(0))
    log = log.withColumn("last", F.array_max(resets))
    tail = F.when(F.col("last") == 0, F.col("log")).otherwise(F.slice("log", F.col("last"), F.size("log") - F.col("last") + 1))
    words = F.transform(F.filter(tail, lambda e: e["kind"].isin("delta", "edit")), lambda e: e["text"])
    alive = F.exists(tail, lambda e: e["kind"].isin("delta", "edit")) | ~F.exists(tail, lambda e: e["kind"] == "delete")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.where(alive).select(
        "conv_id", "message_id", "place", F.when(F.size(roles) > 0, F.element_at(roles, -1)).alias("role"),
        F.array_join(words, "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end of every ``learn`` text, in code points)."""
    turn = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(BODY))
    rows = messages.select("conv_id", "place", "message_id", "role", turn.alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("place", "message_id")
    length = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("end", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
    rows = rows.withColumn("nth", F.row_number().over(order))
    span = F.when(F.col("role") == learn, F.struct((F.col("end") - F.length("body")).alias("start"), F.col("end").alias("end")))
    parts = F.array_sort(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))))
    grouped = rows.groupBy("conv_id").agg(parts.alias("parts"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss) from the rendered texts alone: role and text per turn, and the texts under the mask."""
    pieces = F.filter(F.split("formatted", END.replace("\n", "\\n")), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), BODY, 1)).alias("role"),
        unescape(F.substring_index(p, BODY, -1)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rendered.select("conv_id", "formatted", turns.alias("turns"), masked.alias("loss"))


def turn_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: each row is a message that arrives in two deltas."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "message_id", F.row_number().over(order).cast("bigint"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.substring(F.col("text"), F.lit(1), half).alias("part")),
                    F.struct(F.lit(1).alias("k"), F.substring(F.col("text"), half + 1, F.length("text")).alias("part")))
    return rows.select("conv_id", "role", "message_id", F.explode(parts).alias("p")).select(
        "conv_id", (F.col("message_id") * 2 + F.col("p.k")).alias("seq"), "message_id", F.lit("delta").alias("kind"),
        "role", F.col("p.part").alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered conversations of a turn table (conv_id, turn, role, text).

    Every row is a turn; rows are ordered by turn, ties by role and text, null turns first, and repeated rows are
    repeated turns. Null texts are empty, a null role is an empty role, rows with a null conv_id form one conversation
    with a null id. Other columns are not read. An empty table gives an empty result.
    """
    return render(fold_events(turn_events(conversations)))
