"""Checks of text dates and of keys shared by two maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: str | Column) -> Column:
    """The date of a ``YYYY-MM-DD`` text; NULL for any other form and for days that don't exist."""
    value = F.col(text) if isinstance(text, str) else text
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def shared_keys(left: str | Column, right: str | Column) -> Column:
    """Sorted keys that both maps hold."""
    return F.array_sort(F.array_intersect(F.map_keys(left), F.map_keys(right)))


def shared_values(left: str | Column, right: str | Column, combine) -> Column:
    """Map over the shared keys with ``combine(left value, right value)``."""
    both = F.map_zip_with(left, right, lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))
    held = F.map_filter(both, lambda k, v: F.map_contains_key(left, k) & F.map_contains_key(right, k))
    return F.transform_values(held, lambda k, v: combine(v["a"], v["b"]))
