"""Reading providers' output lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .requests import LABEL
from .variants import at, integer_at, is_a, is_object, items_at, let, string_at

PROVIDERS = ("openai", "anthropic", "gemini")


def _text_of(part: Column) -> Column:
    """A string; the string under text, or under text.value; else null."""
    direct = F.when(is_a(part, "STRING"), F.try_variant_get(part, "$", "string"))
    return F.coalesce(direct, string_at(part, "$.text"), string_at(part, "$.text.value"))


def _content(owner: Column, path: str) -> Column:
    """Fragments of a content that is a string or an array of parts."""
    parts = F.filter(F.transform(items_at(owner, path), _text_of), lambda t: t.isNotNull())
    return let(string_at(owner, path), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts))


def _own_text(item: Column) -> Column:
    return F.array_compact(F.array(F.coalesce(string_at(item, "$.text"), string_at(item, "$.text.value"))))


def openai_text(record: Column) -> Column:
    """Fragments of output, output_text and choices, in this order, that aren't
    empty, a line each."""
    body = let(at(record, "$.response.body"), lambda inner: F.when(is_object(inner), inner).otherwise(at(record, "$.body")))
    return let(body, _body_text)


def _body_text(body: Column) -> Column:
    none = F.array().cast("array<string>")
    out = F.flatten(F.transform(items_at(body, "$.output"), lambda x: F.when(is_object(x), F.concat(_content(x, "$.content"), _own_text(x))).otherwise(none)))
    plain = F.array_compact(F.array(string_at(body, "$.output_text")))
    picks = F.flatten(F.transform(items_at(body, "$.choices"), lambda x: _content(x, "$.message.content")))
    return F.coalesce(F.array_join(F.filter(F.concat(out, plain, picks), lambda t: t != ""), "\n"), F.lit(""))


def anthropic_text(record: Column) -> Column:
    """Text blocks, empty ones too, a line each."""
    blocks = items_at(record, "$.result.message.content")
    texts = F.transform(blocks, lambda b: F.when(string_at(b, "$.type") == "text", string_at(b, "$.text")))
    return F.coalesce(F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n"), F.lit(""))


def gemini_text(record: Column) -> Column:
    """response.text, or the parts of all candidates that aren't empty, a line each."""
    parts = F.flatten(F.transform(items_at(record, "$.response.candidates"), lambda c: items_at(c, "$.content.parts")))
    texts = F.filter(F.transform(parts, lambda p: string_at(p, "$.text")), lambda t: t != "")
    return F.coalesce(string_at(record, "$.response.text"), F.array_join(texts, "\n"), F.lit(""))


def extract_text(record: Column, provider: str) -> Column:
    return let(record, {"openai": openai_text, "anthropic": anthropic_text, "gemini": gemini_text}[provider])


def parse_lines(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Adds ``record`` (VARIANT) to output lines, blank ones dropped. A line that
    isn't a JSON object fails the query, naming the line's head."""
    bad = F.raise_error(F.concat(F.lit("an output line is not a JSON object: "), F.substring(value, 1, 80)))
    return lines.where(F.trim(value) != "").withColumn("record", let(F.try_parse_json(F.col(value)), lambda v: F.when(is_object(v), v).otherwise(bad.cast("variant"))))


def correlation(record: Column, provider: str) -> Column:
    """The id of a record, null if it has none that is a non-empty string."""
    if provider == "gemini":
        first = string_at(record, "$.key")
        found = F.coalesce(F.when(first != "", first), string_at(record, f"$.request.labels.{LABEL}"))
    else:
        found = string_at(record, "$.custom_id")
    return F.when(found != "", found)


def failed(record: Column, from_error_file: Column, provider: str) -> Column:
    """Whether a record reports a failure."""
    if provider == "openai":
        return from_error_file | F.coalesce(integer_at(record, "$.response.status_code") >= 400, F.lit(False))
    if provider == "anthropic":
        return ~F.coalesce(string_at(record, "$.result.type") == "succeeded", F.lit(False))
    status = F.coalesce(F.trim(string_at(record, "$.status")), F.lit(""))
    return at(record, "$.error").isNotNull() | (status != "") | ~is_object(at(record, "$.response"))


def split_outputs(records: DataFrame, provider: str) -> DataFrame:
    """``(keys), custom_id, is_error, record, value`` of records that have an id; of
    several with the same id and outcome the last line wins. The text alone is
    shuffled, and read again after: a parsed record would be as large once more.

    Needs provider_batch_id, from_error_file and line_number: they order the lines."""

    def said(r: Column) -> Column:
        cid = correlation(r, provider)
        known = cid if provider != "anthropic" else F.when(is_object(at(r, "$.result")), cid)
        return F.struct(known.alias("custom_id"), failed(r, F.col("from_error_file"), provider).alias("is_error"))

    keys = ("provider_batch_id", "from_error_file", "line_number", "value")
    tagged = records.select(*keys, let(F.col("record"), said).alias("_said")).select(*keys, "_said.*").where("custom_id is not null")
    w = Window.partitionBy("provider_batch_id", "custom_id", "is_error").orderBy(F.desc("from_error_file"), F.desc("line_number"))
    return tagged.withColumn("_last", F.row_number().over(w)).where("_last = 1").drop("_last").withColumn("record", F.parse_json("value"))


def normal_status(status: Column, provider: str) -> Column:
    """A provider's batch state in the engine's words."""
    if provider == "openai":
        return status
    if provider == "anthropic":
        return F.when(status == "ended", "completed").otherwise("in_progress")
    s = F.regexp_replace(F.upper(status), "^(JOB|BATCH)_STATE_", "")
    partly = F.upper(status) == "JOB_STATE_PARTIALLY_SUCCEEDED"
    return (
        F.when((s == "SUCCEEDED") | partly, "completed").when(s == "FAILED", "failed").when(s == "CANCELLED", "cancelled")
        .when(s == "EXPIRED", "expired").otherwise("submitted")
    )


def gemini_inline_lines(batch: DataFrame) -> DataFrame:
    """Inline responses (``responses array<variant>``) as keyed output lines."""
    e = F.explode("responses").alias("r")
    text = lambda p: F.to_json(F.variant_get("r", p, "variant"))
    return batch.select(e).select(
        F.concat(
            F.lit('{"key":'), F.to_json(F.variant_get("r", "$.metadata.key", "variant")),
            F.coalesce(F.concat(F.lit(',"response":'), text("$.response")), F.concat(F.lit(',"error":'), text("$.error")), F.lit("")), F.lit("}"),
        ).alias("value")
    )
