"""Column functions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name)


def affixed(items: Column, prefix: str = "", suffix: str = "") -> Column:
    """Each item of an array with a prefix and a suffix."""
    return F.transform(items, lambda x: F.concat(F.lit(prefix), x, F.lit(suffix)))


def mapped(items: Column, pattern: str, replacement: str) -> Column:
    return F.transform(items, lambda x: F.regexp_replace(x, pattern, replacement))


def json_number(payload: Column, key: str) -> Column:
    return F.get_json_object(payload, f"$.{key}").cast("bigint")


def ratio(hit: Column) -> Column:
    """Share of rows where hit is true; a null counts as a miss."""
    return F.avg(F.when(hit, 1.0).otherwise(0.0))


def safe_modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised_source(text: Column, name: Column) -> Column:
    """Source text without comments and its own test name (with the letter of a part), white space as one space, for duplicate detection."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")
    named = F.regexp_replace(bare, F.concat(F.lit("\\Q"), name, F.lit("\\E[b-e]?")), F.lit(""))
    return F.trim(F.regexp_replace(named, r"\s+", " "))
