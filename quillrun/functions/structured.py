"""Structured output: fences, JSON, and a schema's types.

Validation is by presence and type class with safe casts: an integer may be a
number's value, a numeric string too; a string must be a string. It doesn't try to
be any particular validation library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import is_object, kind, let

_FENCE = r"(?is)^```(?:json)?\s*\n?(.*?)\n?```\s*$"
_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def strip_fence(text: Column) -> Column:
    """What a Markdown fence around the whole text holds, else the text, trimmed."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_extract(t, _FENCE, 1), r"^\s+|\s+$", "")
    return F.when(t.rlike(_FENCE), inner).otherwise(t)


def check_schema(schema: dict) -> None:
    """Raises ValueError unless the schema is strict: an object at the root, no
    anyOf, every object closed and with all its properties required."""
    if "anyOf" in schema or not _is(schema, "object"):
        raise ValueError("the root of an output schema must be an object, without anyOf")
    _check(schema, "$")


def _is(node: dict, name: str) -> bool:
    t = node.get("type")
    return t == name or (isinstance(t, list) and name in t)


def _check(node: object, path: str) -> None:
    if isinstance(node, list):
        for i, x in enumerate(node):
            _check(x, f"{path}[{i}]")
    if not isinstance(node, dict):
        return
    if "anyOf" in node:
        raise ValueError(f"{path}: anyOf isn't strict")
    if _is(node, "object"):
        if node.get("additionalProperties") is not False:
            raise ValueError(f"{path}: additionalProperties must be false")
        names = node.get("properties")
        if isinstance(names, dict):
            required = node.get("required")
            if not isinstance(required, list) or (left := sorted(set(names) - set(map(str, required)))):
                raise ValueError(f"{path}: all properties must be required" + (f", missing {left}" if isinstance(required, list) else ""))
    for k, x in node.items():
        _check(x, f"{path}.{k}")


def close_schema(schema: object) -> object:
    """A copy in which every object says additionalProperties: false."""
    if isinstance(schema, list):
        return [close_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: close_schema(v) for k, v in schema.items()}
    return out | {"additionalProperties": False} if _is(out, "object") else out


def _valid(v: Column, node: dict) -> Column:
    k = kind(v)
    if "enum" in node:
        return F.coalesce(F.to_json(v).isin([f'"{x}"' if isinstance(x, str) else str(x).lower() for x in node["enum"]]), F.lit(False))
    names = node.get("type")
    names = names if isinstance(names, list) else [names]
    ok = F.lit(False)
    for name in names:
        if name == "null":
            one = k == "VOID"
        elif name == "string":
            one = k == "STRING"
        elif name == "boolean":
            one = k == "BOOLEAN"
        elif name == "integer":
            text = F.when(k == "STRING", F.try_variant_get(v, "$", "string"))
            one = (k == "BIGINT") | F.coalesce(text.rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))
        elif name == "number":
            one = k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") | ((k == "STRING") & F.try_variant_get(v, "$", "double").isNotNull())
        elif name == "array":
            items = F.try_variant_get(v, "$", "array<variant>")
            inner = node.get("items")
            one = (k == "ARRAY") & (F.coalesce(F.forall(items, lambda x: _valid(x, inner)), F.lit(False)) if inner else F.lit(True))
        else:
            one = k == "OBJECT"
            for key, sub in (node.get("properties") or {}).items():
                one = one & let(F.try_variant_get(v, f"$.{key}", "variant"), _present(sub))
        ok = ok | one
    return F.coalesce(ok, F.lit(False))


def _present(node: dict) -> Callable[[Column], Column]:
    return lambda x: x.isNotNull() & _valid(x, node)


def validate(text: Column, schema: dict) -> Column:
    """``struct<error_class, output_json>``: the JSON where the text holds a valid
    document; else empty_response_text, invalid_json or
    structured_output_validation_failed."""
    doc = strip_fence(text)

    def checked(v: Column) -> Column:
        error = (
            F.when(F.coalesce(text, F.lit("")) == "", "empty_response_text")
            .when(v.isNull() & ~doc.eqNullSafe(F.lit("null")), "invalid_json")
            .when(~_valid(v, schema), "structured_output_validation_failed")
        )
        return let(error, lambda e: F.struct(e.alias("error_class"), F.when(e.isNull(), F.to_json(v)).alias("output_json")))

    return let(F.try_parse_json(doc), checked)


def output_type(schema: dict) -> str:
    """The Spark type of a schema's documents, for ``from_json``."""
    names = schema.get("type")
    name = next((n for n in names if n != "null"), "string") if isinstance(names, list) else names
    if name == "object":
        return "struct<" + ",".join(f"`{k}`:{output_type(v)}" for k, v in (schema.get("properties") or {}).items()) + ">"
    if name == "array":
        return f"array<{output_type(schema.get('items') or {})}>"
    return _TYPES.get(name, "string")


__all__ = ["check_schema", "close_schema", "is_object", "output_type", "strip_fence", "validate"]
