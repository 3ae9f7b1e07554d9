"""Provider request lines as JSON Columns.

The canonical form is compact JSON as ``to_json`` writes it; absent keys are left
out, as null struct fields are dropped.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import short_id

RESPONSES, CHAT = "/v1/responses", "/v1/chat/completions"
LABEL = "run_item_id"


@dataclass(frozen=True)
class OutputSchema:
    name: str
    schema: dict


def _present(text: Column | None) -> Column:
    """A non-empty string, else null."""
    return F.when(text != "", text) if text is not None else F.lit(None).cast("string")


def _splice(line: Column, marks: dict[str, object]) -> Column:
    """Replaces quoted marks by fixed JSON, so that user-given structures keep their shape."""
    for mark, value in marks.items():
        line = F.replace(line, F.lit(f'"{mark}"'), F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)))
    return line


def _mark(name: str, value: object | None) -> tuple[Column, dict[str, object]]:
    mark = f"\u0001{name}\u0001"
    escaped = json.dumps(mark)[1:-1]
    return (F.lit(mark), {escaped: value}) if value is not None else (F.lit(None).cast("string"), {})


def responses_line(
    custom_id: Column, prompt: Column, system: Column | None = None, *, model: str = "m", effort: str | None = None,
    output: OutputSchema | None = None,
) -> Column:
    fmt, marks = _mark("format", output and {"type": "json_schema", "name": output.name, "strict": True, "schema": output.schema})
    body = F.struct(
        F.lit(model).alias("model"), prompt.alias("input"), _present(system).alias("instructions"),
        (F.struct(F.lit(effort).alias("effort")) if effort else F.lit(None).cast("struct<effort:string>")).alias("reasoning"),
        F.when(fmt.isNotNull(), F.struct(fmt.alias("format"))).alias("text"),
    )
    line = F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(RESPONSES).alias("url"), body.alias("body"))
    return _splice(F.to_json(line), marks)


def messages(prompt: Column, system: Column | None = None) -> Column:
    """A system message, if there is one, and the user's."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = F.array(say("user", prompt))
    if system is None:
        return user
    return F.when(F.coalesce(system, F.lit("")) != "", F.array(say("system", system), say("user", prompt))).otherwise(user)


def chat_line(
    custom_id: Column, prompt: Column, system: Column | None = None, *, model: str = "m", output: OutputSchema | None = None,
    conversation: Column | None = None,
) -> Column:
    """``conversation`` (an array of role and content) stands in for prompt and system."""
    shape = output and {"type": "json_schema", "json_schema": {"name": output.name, "strict": True, "schema": output.schema}}
    fmt, marks = _mark("format", shape)
    body = F.struct(
        F.lit(model).alias("model"), (conversation if conversation is not None else messages(prompt, system)).alias("messages"),
        fmt.alias("response_format"),
    )
    line = F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(CHAT).alias("url"), body.alias("body"))
    return _splice(F.to_json(line), marks)


def anthropic_line(
    custom_id: Column, prompt: Column, system: Column | None = None, *, model: str = "m", max_tokens: int = 1024,
    params: dict | None = None, output: OutputSchema | None = None,
) -> Column:
    """Extra ``params`` come first; the engine's own keys win over them."""
    extra = {k: v for k, v in (params or {}).items() if k not in ("model", "max_tokens", "messages", "system", "output_config")}
    marks: dict[str, object] = {}
    fields = []
    for k, v in extra.items():
        col, m = _mark(k, v)
        fields.append(col.alias(k))
        marks |= m
    fmt, m = _mark("output_config", output and {"format": {"type": "json_schema", "schema": output.schema}})
    body = F.struct(
        *fields, F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), messages(prompt).alias("messages"),
        _present(system).alias("system"), fmt.alias("output_config"),
    )
    return _splice(F.to_json(F.struct(short_id(custom_id).alias("custom_id"), body.alias("body"))), marks | m)


def gemini_line(
    custom_id: Column, prompt: Column, system: Column | None = None, *, vertex: bool = False, config: dict | None = None,
    output: OutputSchema | None = None,
) -> Column:
    settings = dict(config or {})
    if output:
        settings |= {"response_mime_type": "application/json", "response_json_schema": output.schema}
    cfg, marks = _mark("generation_config", settings or None)
    part = lambda text: F.array(F.struct(text.alias("text")))
    there = _present(system)
    fields = [
        F.array(F.struct(F.lit("user").alias("role"), part(prompt).alias("parts"))).alias("contents"),
        F.when(there.isNotNull(), F.struct(part(there).alias("parts"))).alias("system_instruction"),
        cfg.alias("generation_config"),
    ]
    if vertex:
        fields.append(F.struct(short_id(custom_id).alias(LABEL)).alias("labels"))
        return _splice(F.to_json(F.struct(F.struct(*fields).alias("request"))), marks)
    return _splice(F.to_json(F.struct(custom_id.alias("key"), F.struct(*fields).alias("request"))), marks)


def gemini_inline(line: Column) -> Column:
    """A Developer line as an inline request: contents, metadata.key and config."""
    v = F.parse_json(line)
    text = lambda p: F.get_json_object(line, p)
    config = text("$.request.generation_config")
    system = text("$.request.system_instruction")
    inner = F.concat_ws(
        ",", F.when(config.isNotNull() & (config != "{}"), config.substr(F.lit(2), F.length(config) - 2)),
        F.when(system.isNotNull(), F.concat(F.lit('"system_instruction":'), system)),
    )
    key = F.to_json(F.struct(F.try_variant_get(v, "$.key", "string").alias("key")))
    head = F.concat(F.lit('{"contents":'), text("$.request.contents"), F.lit(',"metadata":'), key)
    return F.concat(head, F.when(inner != "", F.concat(F.lit(',"config":{'), inner, F.lit("}"))).otherwise(""), F.lit("}"))


def correlation_id(line: Column, *, provider: str) -> Column:
    """The id a request or output line carries."""
    if provider != "gemini":
        return F.get_json_object(line, "$.custom_id")
    key = F.get_json_object(line, "$.key")
    return F.coalesce(F.when(key != "", key), F.get_json_object(line, f"$.request.labels.{LABEL}"))


def with_correlation_id(line: Column, custom_id: Column, *, provider: str) -> Column:
    """The line of a replayed request under its next attempt's id; the body's bytes
    stay. Our lines begin with the id, or end with it for Vertex."""
    text = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    if provider == "gemini":
        name, value = "key", custom_id
        vertex = F.regexp_replace(line, rf'"labels":\{{"{LABEL}":"b[0-9a-f]{{40}}"\}}', F.concat(F.lit(f'"labels":{{"{LABEL}":"'), short_id(custom_id), F.lit('"}')))
    else:
        name, value = "custom_id", short_id(custom_id) if provider == "anthropic" else custom_id
        vertex = line
    old = text(F.get_json_object(line, f"$.{name}"))
    head = F.length(F.concat(F.lit(f'{{"{name}":'), old))
    swapped = F.concat(F.lit(f'{{"{name}":'), text(value), line.substr(head + 1, F.length(line)))
    return F.when(line.startswith(f'{{"{name}":'), swapped).otherwise(vertex)


def request_sha256(line: Column) -> Column:
    return F.sha2(line, 256)


def request_bytes(line: Column) -> Column:
    """Bytes of the line as written, with its line end."""
    return (F.octet_length(line) + 1).cast("bigint")
