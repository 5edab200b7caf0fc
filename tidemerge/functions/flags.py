"""Flag sets: sorted, distinct arrays of strings, and their element-wise algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(flags: Column) -> Column:
    """Sorted, distinct, without nulls; a null set is empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(flags, empty))))


def merge_text(base: str, local: str, remote: str) -> str:
    """SQL: what both sides keep, and what either side added since base."""
    return f"array_sort(array_distinct(concat(array_intersect({local}, {remote}), array_except({local}, {base}), array_except({remote}, {base}))))"


def merge(base: Column, local: Column, remote: Column) -> Column:
    """What both sides keep, and what either side added since base."""
    kept, ours, theirs = F.array_intersect(local, remote), F.array_except(local, base), F.array_except(remote, base)
    return F.array_sort(F.array_distinct(F.concat(kept, ours, theirs)))


def contains(flags: Column, flag: str) -> Column:
    return F.coalesce(F.array_contains(flags, flag), F.lit(False))


def added(base: Column, side: Column) -> Column:
    return F.array_sort(F.array_except(side, base))


def removed(base: Column, side: Column) -> Column:
    return F.array_sort(F.array_except(base, side))


def text(flags: Column) -> Column:
    """Comma-joined, for reports."""
    return F.array_join(flags, ",")
