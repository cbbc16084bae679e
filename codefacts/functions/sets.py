"""Type sets: sorted arrays of distinct strings, so that equal sets are equal arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def type_set(*members: str) -> Column:
    return F.array(*[F.lit(m) for m in sorted(set(members))]) if members else F.array().cast("array<string>")


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def erase(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def gathered(member: Column) -> Column:
    """Aggregate: the set of a group's members. Distinct values are collected, not rows."""
    return F.array_sort(F.collect_set(member))


def merged(sets: Column) -> Column:
    """Aggregate: the union of a group's sets."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sets))))


def may_be_null(types: Column) -> Column:
    """The type is unknown, or a member's text says null or mixed."""
    return (F.size(types) == 0) | F.exists(types, lambda t: F.contains(t, F.lit("null")) | F.contains(t, F.lit("mixed")))
