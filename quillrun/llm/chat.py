"""Chat formatting from event logs.

A log holds events of conversations in sequence: ``message`` sets a turn's text,
``delta`` adds to it, ``edit`` replaces it, ``regenerate`` discards the turn and
all later ones (what follows builds it anew), ``delete`` removes the turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string"
TEMPLATES = {
    "chatml": ("<|im_start|>", "\n", "<|im_end|>\n"),
    "plain": ("", ": ", "\n"),
}


def fold_events(events: DataFrame) -> DataFrame:
    """The conversations' final messages: ``conv_id, turn, role, text``.

    The fold is declarative. In a conversation sorted by (seq, kind, turn, role,
    text), an event counts unless a later regenerate is at its turn or an earlier
    one; of a turn's counting events only those from its last message, edit or
    delete on matter; their texts are joined. All windows share one partitioning by
    conversation, so events are shuffled once, and windows spill where a
    conversation is long.

    An event delivered twice (equal in all columns) counts once. A null seq sorts
    first; a null text adds nothing; the role is that of the turn's last counting
    event that has one, else ``unknown``; an event without conversation, turn
    (but regenerate without turn discards all) or known kind is ignored. A turn
    whose last reset deletes it is absent, unless deltas follow; a conversation of
    no turns has no row. Other columns are ignored; an empty log gives no rows.
    """
    known = F.lower("kind").isin("message", "delta", "edit", "regenerate", "delete")
    e = events.select(
        "conv_id", F.col("seq").cast("bigint").alias("seq"), F.lower("kind").alias("kind"),
        F.when(F.lower("kind") == "regenerate", F.coalesce("turn", F.lit(-(1 << 62)))).otherwise(F.col("turn")).cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).where(known & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    order = ["seq", "kind", "turn", "role", "text"]
    log = Window.partitionBy("conv_id").orderBy(*order)
    same = F.lit(True)
    for c in order:
        same = same & F.lag(c).over(log).eqNullSafe(F.col(c))
    numbered = e.select("*", F.row_number().over(log).alias("n"), same.alias("again")).where(~F.coalesce("again", F.lit(False)))
    # The last regenerate at this turn or an earlier one.
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    voided = F.max(F.when(F.col("kind") == "regenerate", F.col("n"))).over(upto)
    living = numbered.select("*", voided.alias("v")).where((F.col("kind") != "regenerate") & (F.coalesce("v", F.lit(0)) < F.col("n")))
    turn = Window.partitionBy("conv_id", "turn")
    reset = F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(turn)
    kept = living.select("*", reset.alias("r")).where((F.col("n") >= F.coalesce("r", F.lit(0))) & (F.col("kind") != "delete"))
    parts = F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text"))))
    return kept.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n"))), F.lit("unknown")).alias("role"),
        F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"),
    )


def escape(text: Column) -> Column:
    """Control marks inside a message can't open or close one."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def render(messages: DataFrame, *, template: str = "chatml") -> DataFrame:
    """One row a conversation: ``conv_id, n_messages, text``, messages by turn
    (then role, text, where turns repeat)."""
    head, mid, tail = TEMPLATES[template]
    line = F.concat(F.lit(head), escape(F.col("role")), F.lit(mid), escape(F.coalesce("text", F.lit(""))), F.lit(tail))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line"))))
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.concat_ws("", F.transform(ordered, lambda m: m["line"])).alias("text")
    )


def log_of_turns(conversations: DataFrame, *, delta_chars: int = 64) -> DataFrame:
    """A conversations table (conv_id, turn, role, text) as the log that streaming
    would have left: users' and system turns as one message; an assistant's first
    as a draft that is then regenerated, streamed in deltas of ``delta_chars``; and
    each conversation's first turn, last, edited to what it was."""
    t = conversations.select("conv_id", "turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / delta_chars) - 1, F.lit(0)).cast("int")),
        lambda i: F.struct(F.lit("delta").alias("kind"), text.substr(i * delta_chars + 1, F.lit(delta_chars)).alias("text")),
    )
    event = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    streamed = F.concat(
        F.array(event("delta", F.lit("draft ")), event("delta", F.lit("to be dropped")), event("regenerate", F.lit(None).cast("string"))), pieces
    )
    whole = F.concat(
        F.array(event("message", F.col("text"))),
        F.when(F.col("turn") == 0, F.array(event("delta", F.lit(" (typo)")), event("edit", F.col("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")),
    )
    events = F.when(F.col("role") == "assistant", streamed).otherwise(whole)
    return t.select("conv_id", "turn", "role", F.posexplode(events).alias("i", "e")).select(
        "conv_id", (F.col("turn") * (1 << 31) + F.col("i")).alias("seq"), F.col("e.kind").alias("kind"), "turn", "role", F.col("e.text").alias("text")
    )


ORACLE = """SELECT conv_id, count(*) AS n_messages, string_agg('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') || chr(10)
  || replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id"""
