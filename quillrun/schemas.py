"""Tables, states and limits of a run."""

from __future__ import annotations

PENDING, QUEUED, SUBMITTED = "pending", "queued_local", "submitted"
COMPLETED, RETRYABLE, PERMANENT = "completed", "failed_retryable", "failed_permanent"
CLAIMABLE = (PENDING, RETRYABLE)
TERMINAL = (COMPLETED, PERMANENT)
ITEM_STATUSES = (PENDING, QUEUED, SUBMITTED, COMPLETED, RETRYABLE, PERMANENT)

RUN_RUNNING, RUN_COMPLETED, RUN_WITH_FAILURES = "running", "completed", "completed_with_failures"
CONTROL_RUNNING, CONTROL_PAUSED, CONTROL_CANCEL = "running", "paused", "cancel_requested"
BATCH_TERMINAL = ("completed", "failed", "cancelled", "expired")
INTENT_CREATING, INTENT_ACTIVE = "creating", "active"
INTENT_ABANDONED, INTENT_OPERATOR = "abandoned", "operator_abandoned"

SCHEMA_VERSION = 1

FAILURE = "struct<error_class:string,message:string,retryable:boolean,raw_error:string>"
#: Current state of items, one row an item of a run.
ITEMS = (
    "run_id string, item_id string, item_index bigint, payload_json string, metadata_json string, prompt string, "
    "system_prompt string, request_artifact_path string, request_artifact_line int, request_sha256 string, status string, "
    "attempt_count int, active_batch_id string, active_custom_id string, active_submission_tokens bigint, "
    "terminal_result_sequence bigint, terminalized_at timestamp, output_text string, output_json string, "
    f"raw_response_json string, error {FAILURE}"
)
BATCHES = (
    "run_id string, provider_batch_id string, local_batch_id string, status string, custom_ids array<string>, "
    "output_file_id string, error_file_id string, output_artifact_path string, error_artifact_path string"
)
INTENTS = (
    "run_id string, intent_id string, quota_scope string, status string, provider_batch_id string, local_batch_id string, "
    "reserved_tokens bigint, released boolean, submissions array<struct<item_id:string,custom_id:string,submission_tokens:bigint>>"
)
EVENTS = "run_id string, seq bigint, event_type string, provider_kind string, data string"
TABLES = {"items": ITEMS, "batches": BATCHES, "intents": INTENTS, "events": EVENTS}
#: What names a row of a table: later versions of a key replace earlier ones.
KEYS = {
    "items": ("run_id", "item_id"),
    "batches": ("run_id", "provider_batch_id"),
    "intents": ("run_id", "intent_id"),
    "events": ("run_id", "seq"),
}
