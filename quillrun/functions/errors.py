"""Classifying provider errors.

An error is a JSON document of any shape (or a plain message). Its text fragments
are all strings in it, keys too, and scalars as text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTA, ENQUEUE = "insufficient_quota", "enqueue_token_limit"
TRANSIENT, OTHER = "control_plane_transient", "batch_error"
_TRANSIENT = (
    "rate limit|too many requests|timed out|timeout|temporarily unavailable|service unavailable"
    "|internal server error|connection error|connection reset"
)
_CLASSES = "ratelimiterror|apitimeouterror|apiconnectionerror|internalservererror"


def walk(value: object) -> list[str]:
    """All text fragments of a parsed error, depth first."""
    if value is None or value == "":
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [x for k, v in value.items() for part in (k, v) for x in walk(part)]
    if isinstance(value, list):
        return [x for v in value for x in walk(v)]
    return [str(value)]


def status_codes(value: object) -> list[int]:
    """Integers under status_code, status or code anywhere in a parsed error."""
    if isinstance(value, list):
        return [x for v in value for x in status_codes(v)]
    if not isinstance(value, dict):
        return []
    own = [value.get(k) for k in ("status_code", "status", "code")]
    found = [int(x) for x in own if (isinstance(x, int) and not isinstance(x, bool)) or (isinstance(x, str) and x.isdecimal())]
    return found + [x for v in value.values() for x in status_codes(v)]


def _parsed(text: str | None) -> object:
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


#: As a type object: a DDL string would need a session when the module is imported.
_DEEP = T.StructType([T.StructField("fragments", T.ArrayType(T.StringType())), T.StructField("codes", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_DEEP)
def _deep(errors: pd.Series) -> pd.DataFrame:
    values = [_parsed(x) for x in errors]
    return pd.DataFrame({"fragments": [walk(v) for v in values], "codes": [status_codes(v) for v in values]})


def deep_fragments(error: Column) -> Column:
    """``struct<fragments, codes>`` at any depth, by an Arrow UDF: errors only, not the hot path."""
    return _deep(error)


def shallow_fragments(error: Column) -> Column:
    """The same for errors that are plain text or an object of scalars, one object
    deep, inside the JVM."""
    flat = F.from_json(error, "map<string,string>")
    codes = F.filter(F.transform(F.array(F.lit("status_code"), F.lit("status"), F.lit("code")), lambda k: F.try_element_at(flat, k)), lambda x: x.rlike(r"^\d+$"))
    parts = F.concat(F.map_keys(flat), F.map_values(flat))
    nested = F.coalesce(F.filter(parts, lambda x: x.isNotNull() & (x != "")), F.array(error))
    return F.struct(nested.alias("fragments"), F.coalesce(F.transform(codes, lambda x: x.cast("int")), F.array().cast("array<int>")).alias("codes"))


def _folded(fragment: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fragment), r"\s+", " "))


def is_enqueue_limit(found: Column) -> Column:
    """Some one fragment speaks of enqueuing, tokens and a limit."""
    def one(x: Column) -> Column:
        t = _folded(x)
        return t.contains("enqueue") & t.contains("token") & t.contains("limit")

    return F.coalesce(F.exists(found["fragments"], one), F.lit(False))


def is_insufficient_quota(found: Column) -> Column:
    """insufficient_quota in a fragment; or status 429 with words on quota, billing or spending."""
    def named(x: Column) -> Column:
        return F.replace(_folded(x), F.lit("-"), F.lit("_")).contains("insufficient_quota")

    def spent(x: Column) -> Column:
        t = F.replace(_folded(x), F.lit("-"), F.lit("_"))
        return t.rlike("current quota|billing|credits|monthly spend|spend limit") | (t.contains("quota") & t.contains("plan"))

    f = found["fragments"]
    limited = F.coalesce(F.array_contains(found["codes"], 429), F.lit(False))
    return F.coalesce(F.exists(f, named), F.lit(False)) | (limited & F.coalesce(F.exists(f, spent), F.lit(False)))


def is_transient(found: Column, class_name: Column | None = None) -> Column:
    said = F.coalesce(F.exists(found["fragments"], lambda x: _folded(x).rlike(_TRANSIENT)), F.lit(False))
    if class_name is not None:
        said = said | F.coalesce(F.lower(class_name).rlike(_CLASSES), F.lit(False))
    return said | is_enqueue_limit(found) | is_insufficient_quota(found)


def classify(found: Column, class_name: Column | None = None, provider: str = "openai") -> Column:
    """quota, then enqueue limit, then transient, then other."""
    return (
        F.when(is_insufficient_quota(found), f"{provider}_{QUOTA}")
        .when(is_enqueue_limit(found), ENQUEUE)
        .when(is_transient(found, class_name), TRANSIENT)
        .otherwise(OTHER)
    )


def batch_failure(found: Column, raw: Column, status: Column, provider: str = "openai") -> Column:
    """The failure that items of a batch that ended badly carry; always retried."""
    kind = (
        F.when(is_insufficient_quota(found), f"{provider}_{QUOTA}")
        .when(is_enqueue_limit(found), ENQUEUE)
        .otherwise(F.concat(F.lit("batch_terminal_"), F.coalesce(status, F.lit("failed"))))
    )
    return F.struct(kind.alias("error_class"), F.lit("the batch ended without completing").alias("message"), F.lit(True).alias("retryable"), raw.alias("raw_error"))
