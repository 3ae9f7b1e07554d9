"""What became of a batch's items: outputs against what was submitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors, responses, structured
from ..schemas import FAILURE, SUBMITTED
from ..workspace import spread

OUTCOMES = "item_id string, custom_id string, provider_batch_id string, outcome string, counts_attempt boolean"


def _failure(kind: Column, message: Column, retryable: bool, raw: Column) -> Column:
    return F.struct(kind.alias("error_class"), message.alias("message"), F.lit(retryable).alias("retryable"), raw.alias("raw_error")).cast(FAILURE)


def still_submitted(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """Output rows of items still submitted in that batch under that id: replays drop out (semi join)."""
    live = items.where(F.col("status") == SUBMITTED)
    on = (outputs["custom_id"] == live["active_custom_id"]) & (outputs["provider_batch_id"] == live["active_batch_id"])
    return outputs.join(live, on, "left_semi")


def missing_rows(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items submitted in the batches at hand that no output row names (anti join)."""
    live = items.where(F.col("status") == SUBMITTED)
    on = (outputs["custom_id"] == live["active_custom_id"]) & (outputs["provider_batch_id"] == live["active_batch_id"])
    return live.join(outputs, on, "left_anti")


def classify_outcomes(
    items: DataFrame, outputs: DataFrame, *, provider: str = "openai", schema: dict | None = None, deep: bool = True
) -> DataFrame:
    """One row an item submitted: ``item_id, item_index, custom_id,
    provider_batch_id, outcome, counts_attempt, error, output_text, output_json,
    raw_response_json``.

    ``outputs`` are ``responses.split_outputs`` rows of completed batches; ``items``
    those submitted in them. A success wins over an error for the same id. Failures:
    quota and enqueue limits don't count as attempts, nor does a row that is
    missing; other errors and answers that break the schema do."""
    live = items.where(F.col("status") == SUBMITTED).select(
        "item_id", "item_index", F.col("active_custom_id").alias("_cid"), F.col("active_batch_id").alias("_bid")
    )
    one = outputs.groupBy("provider_batch_id", "custom_id").agg(F.min_by(F.struct("is_error", "value"), F.col("is_error")).alias("r"))
    j = spread(live.join(one, (live["_cid"] == one["custom_id"]) & (live["_bid"] == one["provider_batch_id"]), "left"), "item_id")
    raw = F.col("r.value")
    rec = F.parse_json(raw)
    text = responses.extract_text(rec, provider)
    # Only error rows are walked for what they say.
    is_error = F.coalesce(F.col("r.is_error"), F.lit(False))
    said = F.when(is_error, raw)
    base = j.select(
        "item_id", "item_index", F.col("_cid").alias("custom_id"), F.col("_bid").alias("provider_batch_id"), is_error.alias("is_error"),
        F.col("r").isNull().alias("missing"), raw.alias("raw"), F.when(~is_error, text).alias("text"),
        (errors.deep_fragments(said) if deep else errors.shallow_fragments(said)).alias("found"),
    )
    if schema:
        base = base.withColumn("checked", structured.validate(F.col("text"), schema))
    else:
        base = base.withColumn("checked", F.struct(F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("string").alias("output_json")))
    found = F.col("found")
    kind = (
        F.when(F.col("missing"), "batch_output_missing_row")
        .when(F.col("is_error") & errors.is_insufficient_quota(found), f"{provider}_{errors.QUOTA}")
        .when(F.col("is_error") & errors.is_enqueue_limit(found), errors.ENQUEUE)
        .when(F.col("is_error"), "provider_item_error")
        .otherwise(F.col("checked.error_class"))
    )
    tagged = base.withColumn("kind", kind)
    uncounted = F.col("missing") | F.col("kind").isin(f"{provider}_{errors.QUOTA}", errors.ENQUEUE)
    ok = F.col("kind").isNull()
    return tagged.select(
        "item_id", "item_index", "custom_id", "provider_batch_id",
        F.when(ok, "completed").otherwise("failed").alias("outcome"), (~F.coalesce(uncounted, F.lit(False))).alias("counts_attempt"),
        F.when(~ok, _failure(F.col("kind"), F.concat(F.lit("item failed: "), "kind"), True, F.col("raw"))).alias("error"),
        F.when(ok, F.col("text")).alias("output_text"), F.col("checked.output_json").alias("output_json"),
        F.when(ok, F.col("raw")).alias("raw_response_json"),
    )


def outcome_histogram(outcomes: DataFrame) -> DataFrame:
    """Items by outcome and error class."""
    return outcomes.groupBy("outcome", F.coalesce("error.error_class", F.lit("")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def quota_errors(outcomes: DataFrame, provider: str = "openai") -> DataFrame:
    """Quota errors by batch."""
    hit = F.col("error.error_class") == f"{provider}_{errors.QUOTA}"
    return outcomes.groupBy("provider_batch_id").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("quota_errors"))
