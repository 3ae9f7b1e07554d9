"""Providers behind a network: thin adapters over an SDK's client, which is given.

A client is any object with the SDK's methods, so that nothing here imports an SDK
and tests give their own. What a provider returns is written under ``root``, in the
shared folder, where Spark reads it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..schemas import BATCH_TERMINAL
from .ledger import Files
from .providers import Batch, Provider, ProviderConfig, gemini_input_mode

KEYS = {"openai": ("OPENAI_API_KEY",), "anthropic": ("ANTHROPIC_API_KEY",), "gemini": ("GEMINI_API_KEY", "GOOGLE_API_KEY")}
_STATES = {"SUCCEEDED": "completed", "FAILED": "failed", "CANCELLED": "cancelled", "EXPIRED": "expired"}


def api_key(kind: str, given: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The key that is given, else the first of the environment's names that is set."""
    env = os.environ if env is None else env
    for value in (given, *(env.get(name) for name in KEYS[kind])):
        if value and value.strip():
            return value.strip()
    raise ValueError(f"no API key for {kind}: give one or set {' or '.join(KEYS[kind])}")


def status_of(status: str, kind: str) -> str:
    """``responses.normal_status`` for one value on the driver."""
    if kind == "openai":
        return status
    if kind == "anthropic":
        return "completed" if status == "ended" else "in_progress"
    if status.upper() == "JOB_STATE_PARTIALLY_SUCCEEDED":
        return "completed"
    return _STATES.get(re.sub("^(JOB|BATCH)_STATE_", "", status.upper()), "submitted")


class RemoteProvider(Provider):
    """What the adapters share: a batch's lines as text, and outputs kept once."""

    threads = 8

    kind = ""

    def __init__(self, config: ProviderConfig, client: object, root: str):
        super().__init__(config)
        if config.kind != self.kind:
            raise ValueError(f"a configuration of {config.kind} was given to {self.kind}")
        self.client, self.root, self.spark = client, root.rstrip("/"), None

    def request_lines(self, spark: SparkSession, path: str) -> list[str]:
        """One batch's lines in their order; the chunk policy bounds their bytes."""
        self.spark = spark
        files = Files(spark, path)
        parts = [n for n in files.names("") if not n.startswith(("_", "."))]
        return [line for n in parts for line in files.read(n).split("\n") if line]

    def keep(self, batch_id: str, kind: str, text: str | None) -> str | None:
        """The folder with a batch's output, written the first time it is seen."""
        if not text:
            return None
        key = f"{re.sub(r'[^A-Za-z0-9._-]', '_', batch_id)}/{kind}/part-0.txt"
        files = Files(self.spark or SparkSession.active(), self.root)
        if not files.exists(key):
            files.create(key, text)
        return files.path(key.rpartition("/")[0])


class OpenAIProvider(RemoteProvider):
    kind = "openai"

    def create(self, spark: SparkSession, path: str, metadata: dict) -> Batch:
        data = ("\n".join(self.request_lines(spark, path)) + "\n").encode()
        sent = self.client.files.create(file=("requests.jsonl", data), purpose="batch")
        made = self.client.batches.create(input_file_id=sent.id, endpoint=self.config.endpoint, completion_window="24h", metadata=metadata)
        return Batch(made.id, status_of(made.status, self.kind))

    def get(self, batch_id: str) -> Batch:
        b = self.client.batches.retrieve(batch_id)
        out = Batch(b.id, status_of(b.status, self.kind))
        if out.status == "completed":
            text = lambda name: self.client.files.content(name).text if name else None
            out.outputs = self.keep(b.id, "output", text(b.output_file_id))
            out.errors = self.keep(b.id, "error", text(b.error_file_id))
        elif out.status in BATCH_TERMINAL:
            out.failure = json.dumps({"id": b.id, "status": b.status, "errors": getattr(b, "errors", None)}, default=str)
        return out


class AnthropicProvider(RemoteProvider):
    kind = "anthropic"

    def create(self, spark: SparkSession, path: str, metadata: dict) -> Batch:
        rows = [json.loads(line) for line in self.request_lines(spark, path)]
        made = self.client.messages.batches.create(requests=[{"custom_id": r["custom_id"], "params": r["body"]} for r in rows])
        return Batch(made.id, status_of(made.processing_status, self.kind))

    def get(self, batch_id: str) -> Batch:
        b = self.client.messages.batches.retrieve(batch_id)
        out = Batch(b.id, status_of(b.processing_status, self.kind))
        if out.status == "completed":
            results = self.client.messages.batches.results(batch_id)
            out.outputs = self.keep(b.id, "output", "".join(_json_of(r) + "\n" for r in results))
        return out


class GeminiProvider(RemoteProvider):
    """Input goes inline, as an uploaded file, or (Vertex) lies in a bucket already."""

    kind = "gemini"

    def __init__(self, config: ProviderConfig, client: object, root: str, *, mode: str = "auto", bucket: str | None = None):
        super().__init__(config, client, root)
        self.mode, self.bucket = mode, bucket

    def create(self, spark: SparkSession, path: str, metadata: dict) -> Batch:
        lines = self.request_lines(spark, path)
        data = ("\n".join(lines) + "\n").encode()
        mode = gemini_input_mode(self.mode, len(data), vertex=self.config.vertex, bucket=self.bucket)
        name = metadata.get("local_batch_id", "batch")
        config: dict = {"display_name": name}
        if mode == "gcs":
            place = f"{self.bucket.rstrip('/')}/{metadata.get('run_id', 'run')}/{name}"
            Files(spark, place).create("requests.jsonl", data.decode())
            source, config["dest"] = f"{place}/requests.jsonl", f"{place}/outputs"
        elif mode == "file":
            source = self.client.files.upload(file=data, config={"mime_type": "jsonl", "display_name": name}).name
        else:
            source = [inline_request(json.loads(line)) for line in lines]
        made = self.client.batches.create(model=self.config.model, src=source, config=config)
        return Batch(made.name, status_of(_state(made), self.kind))

    def get(self, batch_id: str) -> Batch:
        b = self.client.batches.get(name=batch_id)
        out = Batch(b.name, status_of(_state(b), self.kind))
        dest = getattr(b, "dest", None)
        if out.status == "completed" and dest is not None:
            if uri := getattr(dest, "gcs_uri", None):
                out.outputs = uri  # Spark reads the prefix itself
            elif name := getattr(dest, "file_name", None):
                raw = self.client.files.download(file=name)
                out.outputs = self.keep(b.name, "output", raw.decode() if isinstance(raw, bytes) else raw)
            else:
                out.outputs = self.keep(b.name, "output", "".join(inline_line(r) + "\n" for r in getattr(dest, "inlined_responses", None) or []))
        elif out.status in BATCH_TERMINAL:
            out.failure = json.dumps({"id": b.name, "status": _state(b), "error": getattr(b, "error", None)}, default=str)
        return out


def _state(b: object) -> str:
    s = b.state
    return getattr(s, "name", None) or str(s)


def _plain(x: object) -> object:
    if hasattr(x, "model_dump"):
        return x.model_dump(mode="json", exclude_none=True)
    return x


def _json_of(x: object) -> str:
    return json.dumps(_plain(x), ensure_ascii=False, separators=(",", ":"), default=_plain)


def inline_request(row: dict) -> dict:
    """``requests.gemini_inline`` for one parsed line."""
    request = row["request"]
    config = dict(request.get("generation_config") or {})
    if "system_instruction" in request:
        config["system_instruction"] = request["system_instruction"]
    return {"contents": request["contents"], "metadata": {"key": row["key"]}} | ({"config": config} if config else {})


def inline_line(answer: object) -> str:
    """An inline answer as the line that a file would have for it."""
    r = _plain(answer)
    r = r if isinstance(r, dict) else r.__dict__
    line: dict = {"key": (_plain(r.get("metadata")) or {}).get("key")}
    if r.get("response") is not None:
        line["response"] = r["response"]
    elif r.get("error") is not None:
        line["error"] = r["error"]
    return _json_of(line)


REMOTE = {p.kind: p for p in (OpenAIProvider, AnthropicProvider, GeminiProvider)}


def open_provider(config: ProviderConfig, client: object, root: str, **options) -> RemoteProvider:
    """An adapter by the configuration's kind; ``REMOTE`` takes further kinds."""
    if config.kind not in REMOTE:
        raise ValueError(f"no adapter for {config.kind}")
    return REMOTE[config.kind](config, client, root, **options)
