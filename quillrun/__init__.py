"""quillrun: a PySpark-native engine for durable batch-inference runs.

The public names are imported when they are first used."""

from importlib import import_module

__version__ = "0.1.0"

_PUBLIC = {
    "functions.errors": ("classify",),
    "functions.ids": ("custom_id", "namespace", "namespaced", "quota_scope", "run_id"),
    "functions.ordinals": ("dense_number", "dense_order", "with_row_index"),
    "functions.prompts": ("missing_fields", "render_template", "with_lineage", "with_prompt"),
    "functions.requests": (
        "OutputSchema", "anthropic_line", "chat_line", "correlation_id", "gemini_inline", "gemini_line", "request_bytes", "request_sha256",
        "responses_line", "with_correlation_id",
    ),
    "functions.responses": ("extract_text", "normal_status", "parse_lines", "split_outputs"),
    "functions.structured": ("check_schema", "close_schema", "strip_fence", "validate"),
    "functions.tokens": ("ChunkPolicy", "EnqueueLimits", "RetryPolicy", "backoff_delay", "claim_window", "estimate_tokens", "split_oversized"),
    "operators.ingest": ("pending_items", "replay_guard", "to_insert"),
    "operators.outcomes": ("classify_outcomes", "missing_rows", "still_submitted"),
    "operators.packing": ("batch_totals", "pack"),
    "operators.results": ("export_lines", "join_back", "write_export"),
    "operators.summary": ("run_summary", "status_counts"),
    "plans.artifacts": ("export_run", "prune_run", "replay_lines", "write_requests"),
    "plans.ledger": ("CommitConflict", "Files", "Ledger", "MemoryLedger", "ParquetLedger", "RunState", "backfill_markers", "open_ledger"),
    "plans.providers": ("Batch", "LocalProvider", "Provider", "ProviderConfig", "gemini_input_mode"),
    "plans.remote": ("AnthropicProvider", "GeminiProvider", "OpenAIProvider", "RemoteProvider", "api_key", "open_provider"),
    "plans.runner": ("Indeterminate", "Job", "Run", "RunError", "RunNotFinished", "RunPaused", "Runner"),
    "sources.files": (
        "CompositeSource", "CsvSource", "FrameSource", "Identity", "JsonlSource", "ParquetSource", "Part", "Source", "item_rows", "output_lines", "source_for",
    ),
    "streaming.ingest": ("event_counts", "finish_ingest", "ingest_stream", "terminal_tail"),
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = ["__version__", *sorted(_WHERE)]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = globals()[name] = getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    return value


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
