"""Streaming ingestion and the tail of ended items.

Spark's checkpoint holds the source's offset; the ledger's commit holds the rows.
A micro-batch that is replayed after a crash meets the upsert guard, so its rows
are there once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ordinals import dense_order
from ..operators.ingest import pending_items, to_insert
from ..plans.ledger import VERSION, Ledger, ParquetLedger
from ..schemas import ITEMS, TERMINAL


def ingest_stream(
    stream: DataFrame, ledger: Ledger, run_id: str, checkpoint: str, *, item_id: Column, payload: Column, metadata: Column | None = None,
    trigger: dict | None = None, **prompt,
) -> StreamingQuery:
    """Appends each micro-batch's rows to a run, numbered on from those there; a row
    whose id is there with the same payload and metadata is skipped, and one whose
    payload or metadata has changed fails the stream, as an id does that comes with
    two payloads at once."""

    def take(batch: DataFrame, _: int) -> None:
        state = ledger.state(run_id)
        meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
        rows = batch.select(item_id.cast("string").alias("item_id"), payload.alias("payload"), meta.alias("metadata"))
        existing = ledger.current(run_id, "items")
        columns = "item_id", "item_index", "payload", "metadata"
        fresh = rows.join(existing.select("item_id"), "item_id", "left_anti")
        numbered = dense_order(fresh, "item_id", name="item_index", start=state.next_index).select(*columns)
        again = rows.join(existing.select("item_id", "item_index"), "item_id").select(*columns)
        known = pending_items(again, run_id, **prompt).dropDuplicates(["item_id", "payload_json", "metadata_json"])
        deltas = {"items": to_insert(pending_items(numbered, run_id, **prompt).union(known), existing)}
        state.next_index += fresh.count()
        ledger.commit(run_id, deltas, state)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def finish_ingest(ledger: Ledger, run_id: str) -> None:
    state = ledger.state(run_id)
    state.ingested = True
    ledger.commit(run_id, {}, state)


def terminal_tail(spark: SparkSession, ledger: ParquetLedger, run_id: str) -> DataFrame:
    """A stream of items as they end, from the run's deltas. Deltas are read as they
    are written; one whose commit failed can show, so consumers keep what is in
    the ledger's current version (the sequence number tells)."""
    schema = spark.createDataFrame([], f"{ITEMS}, {VERSION} bigint").schema
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(ledger.files.path(f"{run_id}/items"))
    return raw.where(F.col("status").isin(*TERMINAL) & F.col("terminal_result_sequence").isNotNull()).drop(VERSION)


def event_counts(events: DataFrame, *, by: str = "event_type") -> DataFrame:
    """Running counts of an event log, stream or not."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
