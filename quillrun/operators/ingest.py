"""From source rows to items: the upsert guard, and items as pending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import with_prompt
from ..schemas import ITEMS, PENDING
from .summary import duplicate_ids


def pending_items(rows: DataFrame, run_id: str, **prompt) -> DataFrame:
    """Items of ``item_rows`` (item_id, item_index, payload, metadata), with prompts
    made of the payload's fields (see ``with_prompt``) or of columns that are there."""
    if prompt:
        named = rows.select("item_id", "item_index", "payload", "metadata", "payload.*")
        rows = with_prompt(named, **prompt)
    given = {
        "run_id": F.lit(run_id), "item_id": F.col("item_id"), "item_index": F.col("item_index"), "payload_json": F.to_json("payload"),
        "metadata_json": F.to_json("metadata"), "prompt": F.col("prompt"), "system_prompt": F.col("system_prompt"), "status": F.lit(PENDING),
        "attempt_count": F.lit(0),
    }
    columns = []
    for spec in _columns(ITEMS):
        name, kind = spec
        columns.append((given[name] if name in given else F.lit(None)).cast(kind).alias(name))
    return rows.select(*columns)


def _columns(ddl: str) -> list[tuple[str, str]]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append((name, kind))
            start = i + 1
    return out


def replay_guard(incoming: DataFrame, existing: DataFrame, *, replay_from: int = 0) -> DataFrame:
    """Incoming items with ``action``: ``insert`` for a new id; ``skip`` for one that
    is there with the same index, payload and metadata at or after the checkpoint;
    else ``duplicate``. An id twice among the incoming is a duplicate too."""
    old = existing.select(
        F.col("item_id").alias("_id"), F.col("item_index").alias("_index"), F.col("payload_json").alias("_payload"), F.col("metadata_json").alias("_metadata")
    )
    twice = duplicate_ids(incoming).select(F.col("item_id").alias("_twice"))
    j = incoming.join(old, incoming["item_id"] == old["_id"], "left").join(twice, incoming["item_id"] == twice["_twice"], "left")
    # A payload is shed once a request artifact has it; then index and metadata tell.
    same = (
        (F.col("item_index") == F.col("_index")) & F.col("metadata_json").eqNullSafe(F.col("_metadata"))
        & (F.col("_payload").isNull() | F.col("payload_json").eqNullSafe(F.col("_payload"))) & (F.col("item_index") >= replay_from)
    )
    action = F.when(F.col("_twice").isNotNull(), "duplicate").when(F.col("_id").isNull(), "insert").when(same, "skip").otherwise("duplicate")
    return j.withColumn("action", action).select(*incoming.columns, "action")


def to_insert(incoming: DataFrame, existing: DataFrame, *, replay_from: int = 0) -> DataFrame:
    """New items; fails the query on a duplicate id."""
    guarded = replay_guard(incoming, existing, replay_from=replay_from)
    bad = F.raise_error(F.concat(F.lit("duplicate item_id: "), F.col("item_id")))
    checked = guarded.withColumn("item_id", F.when(F.col("action") == "duplicate", bad.cast("string")).otherwise(F.col("item_id")))
    return checked.where("action <> 'skip'").drop("action")
