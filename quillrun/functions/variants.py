"""Reading JSON whose shape isn't known, as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """The outer type of a variant: STRING, BIGINT, OBJECT, ARRAY, VOID and so on."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def is_a(v: Column, name: str) -> Column:
    """Whether the outer type is this one: ``kind`` without a regular expression."""
    return F.schema_of_variant(v).startswith(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), body)[0]


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string_at(v: Column, path: str) -> Column:
    """The string there; null where there is none or something else."""
    return let(at(v, path), lambda x: F.when(is_a(x, "STRING"), F.try_variant_get(x, "$", "string")))


def integer_at(v: Column, path: str) -> Column:
    return let(at(v, path), lambda x: F.when(is_a(x, "BIGINT"), F.try_variant_get(x, "$", "bigint")))


def items_at(v: Column, path: str) -> Column:
    """The elements of the array there; an empty array where there is none."""
    found = let(at(v, path), lambda x: F.when(is_a(x, "ARRAY"), F.try_variant_get(x, "$", "array<variant>")))
    return F.coalesce(found, F.array().cast("array<variant>"))


def is_object(v: Column) -> Column:
    return F.coalesce(is_a(v, "OBJECT"), F.lit(False))
