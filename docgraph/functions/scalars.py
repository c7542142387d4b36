"""Scalar helpers for filters, transformations and reductions, under the names that script authors know, as Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_text(c: Column, start: int, end: int) -> Column:
    """Characters [start, end)."""
    return F.substring(c, start + 1, end - start)


def index_of(c: Column, part: str) -> Column:
    """Position of the first occurrence, or -1."""
    return F.instr(c, part) - 1


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def some(a: Column, test) -> Column:  # noqa: ANN001
    return F.exists(a, test)


def fold(a: Column, start: Column, step) -> Column:  # noqa: ANN001
    return F.aggregate(a, start, step)


def keys_of(json: Column) -> Column:
    return F.json_object_keys(json)


def is_empty(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) == 0


def clamped(c: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def half_up(c: Column) -> Column:
    """Rounded as scripts do: halves go up, also below zero."""
    return F.floor(c + 0.5)


def truncated(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a timestamp or date."""
    return F.unix_millis(c.cast("timestamp"))


def from_epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c)


def iso(c: Column) -> Column:
    """ISO 8601 text of a timestamp in UTC sessions, with milliseconds."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def weekday(c: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(c) - 1


def groups(c: Column, pattern: str, n: int) -> list[Column]:
    """The first n groups of a pattern."""
    return [F.regexp_extract(c, pattern, i + 1) for i in range(n)]
