"""Counts, capacity and the state of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    BATCH_TERMINAL, COMPLETED, INTENT_ACTIVE, INTENT_CREATING, ITEM_STATUSES, PERMANENT, RUN_COMPLETED, RUN_RUNNING, RUN_WITH_FAILURES, SUBMITTED,
)


def status_counts(items: DataFrame, *by: str) -> DataFrame:
    """Items by status."""
    return items.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def status_map(items: DataFrame) -> DataFrame:
    """One row: every status with its count."""
    counts = [F.count_if(F.col("status") == s) for s in ITEM_STATUSES]
    pairs = [x for s, c in zip(ITEM_STATUSES, counts) for x in (F.lit(s), c)]
    return items.agg(F.create_map(*pairs).alias("status_counts"))


def active_batches(batches: DataFrame, items: DataFrame, intents: DataFrame) -> DataFrame:
    """Batches not ended, or with items still submitted, or with an unreleased
    intent: two semi joins, each against distinct keys only."""
    submitted = items.where((F.col("status") == SUBMITTED) & F.col("active_batch_id").isNotNull())
    holding = intents.where(~F.col("released") & F.col("provider_batch_id").isNotNull())
    keys = submitted.select("run_id", F.col("active_batch_id").alias("provider_batch_id")).union(holding.select("run_id", "provider_batch_id")).distinct()
    hit = batches.join(keys.withColumn("_hit", F.lit(True)), ["run_id", "provider_batch_id"], "left")
    on = ~F.col("status").isin(*BATCH_TERMINAL) | F.coalesce("_hit", F.lit(False))
    return hit.where(on).select(*batches.columns).orderBy("local_batch_id")


def run_summary(
    items: DataFrame, batches: DataFrame, intents: DataFrame, *, ingested: bool = True, backoff: float = 0.0
) -> DataFrame:
    """One row: counts and the status of the run. It has ended when all items have,
    no batch is active, no backoff runs and ingestion is complete."""
    s = F.col("status")
    counts = items.agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(s == COMPLETED).alias("completed_items"), F.count_if(s == PERMANENT).alias("failed_items"),
    )
    active = active_batches(batches, items, intents).agg(F.count(F.lit(1)).alias("active_batches"))
    both = counts.crossJoin(F.broadcast(active))  # one row each
    over = (F.col("completed_items") + F.col("failed_items") == F.col("total_items")) & (F.col("active_batches") == 0) & F.lit(ingested and backoff <= 0)
    status = F.when(~over, RUN_RUNNING).when(F.col("failed_items") > 0, RUN_WITH_FAILURES).otherwise(RUN_COMPLETED)
    return both.withColumn("status", status)


def inflight_tokens(items: DataFrame) -> DataFrame:
    """Tokens of items submitted."""
    return items.where(F.col("status") == SUBMITTED).agg(F.coalesce(F.sum("active_submission_tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def next_sequence(items: DataFrame) -> int:
    return int(items.agg(F.coalesce(F.max("terminal_result_sequence"), F.lit(0)) + 1).first()[0])


def legacy_tokens(items: DataFrame, runs: DataFrame, intents: DataFrame) -> DataFrame:
    """``quota_scope, tokens`` of submitted items whose batch no intent stands for;
    ``runs`` has run_id and quota_scope."""
    live = items.where(F.col("status") == SUBMITTED)
    known = intents.where("provider_batch_id is not null").select("run_id", F.col("provider_batch_id").alias("active_batch_id"))
    left = live.join(known, ["run_id", "active_batch_id"], "left_anti").join(runs.select("run_id", "quota_scope"), "run_id")
    return left.groupBy("quota_scope").agg(F.sum("active_submission_tokens").cast("bigint").alias("tokens"))


def reserved_tokens(items: DataFrame, runs: DataFrame, intents: DataFrame) -> DataFrame:
    """``quota_scope, tokens`` held by unreleased intents and legacy batches."""
    held = intents.where(~F.col("released")).select("quota_scope", F.col("reserved_tokens").alias("tokens"))
    both = held.union(legacy_tokens(items, runs, intents))
    return both.groupBy("quota_scope").agg(F.sum("tokens").cast("bigint").alias("tokens"))


def artifact_inventory(items: DataFrame, batches: DataFrame) -> DataFrame:
    """``kind, path``: every artifact a run points to, once."""
    paths = items.select(F.lit("request").alias("kind"), F.col("request_artifact_path").alias("path"))
    for kind in ("output", "error"):
        paths = paths.union(batches.select(F.lit(kind), F.col(f"{kind}_artifact_path")))
    return paths.where("path is not null").distinct()


def submitted_ids(batch: DataFrame, items: DataFrame) -> DataFrame:
    """``pos, custom_id`` of a batch's ids that are still submitted, in its order."""
    ids = batch.select("provider_batch_id", F.posexplode("custom_ids").alias("pos", "custom_id"))
    live = items.where(F.col("status") == SUBMITTED)
    on = (ids["custom_id"] == live["active_custom_id"]) & (ids["provider_batch_id"] == live["active_batch_id"])
    return ids.join(live, on, "left_semi").select("pos", "custom_id").orderBy("pos")


def duplicate_ids(items: DataFrame) -> DataFrame:
    """``item_id, n`` of ids given more than once."""
    return items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def failure_counts(items: DataFrame) -> DataFrame:
    return items.where("error is not null").groupBy("error.error_class").agg(F.count(F.lit(1)).alias("n"))


# Intents


def abandon(intents: DataFrame, intent_id: str, *, operator: bool = False) -> DataFrame:
    """An intent given up, its capacity released; a released one doesn't change."""
    status = "operator_abandoned" if operator else "abandoned"
    return intents.where((F.col("intent_id") == intent_id) & ~F.col("released")).withColumns({"status": F.lit(status), "released": F.lit(True)})


def release_capacity(intents: DataFrame, batch_id: str) -> DataFrame:
    """The active intent of a batch, released; again: nothing."""
    hit = (F.col("provider_batch_id") == batch_id) & (F.col("status") == INTENT_ACTIVE) & ~F.col("released")
    return intents.where(hit).withColumn("released", F.lit(True))


def indeterminate(intents: DataFrame) -> DataFrame:
    return intents.where((F.col("status") == INTENT_CREATING) & ~F.col("released"))


def intent_items(intents: DataFrame) -> DataFrame:
    """The submissions of intents, a row each, with the batch."""
    return intents.select("provider_batch_id", F.inline("submissions"))
