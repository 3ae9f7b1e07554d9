"""Identifiers as Columns."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def custom_id(item_id: Column, attempt_count: Column) -> Column:
    """``<item>:a<n>`` of the next attempt."""
    return F.concat(item_id, F.lit(":a"), (attempt_count + 1).cast("string"))


def short_id(value: Column) -> Column:
    """A provider-safe id of 41 characters: b and the head of a SHA-256."""
    return F.concat(F.lit("b"), F.substring(F.sha2(value, 256), 1, 40))


def namespace(index: Column, kind: Column, ref: Column) -> Column:
    """``src_`` and twelve hexadecimal digits that name one source of several."""
    nul = F.lit("\0")
    digest = F.sha2(F.concat(index.cast("string"), nul, kind, nul, ref), 256)
    return F.concat(F.lit("src_"), F.substring(digest, 1, 12))


def namespaced(ns: Column, item_id: Column) -> Column:
    return F.concat(ns, F.lit("__"), item_id)


def run_id(now: datetime | None = None, token: str | None = None) -> str:
    now = now or datetime.now(UTC)
    return f"run_{now:%Y%m%dT%H%M%SZ}_{token or uuid.uuid4().hex[:8]}"


def local_batch_id(ordinal: int, token: str | None = None) -> str:
    return f"batch-{ordinal:04d}-{token or uuid.uuid4().hex[:8]}"


def intent_id(token: str | None = None) -> str:
    return f"submission-{token or uuid.uuid4().hex}"


def quota_scope(model: str, scope: str | None = None, provider: str = "openai") -> str:
    scope = (scope or "").strip()
    return f"{provider}:{model}:" + (f"label:{scope}" if scope else "default")


def schema_name(class_name: str) -> str:
    """CamelCase in snake case, without leading underscores."""
    parts = re.sub(r"(?<!^)([A-Z])", r"_\1", class_name.lstrip("_"))
    return parts.lower().replace("__", "_")
