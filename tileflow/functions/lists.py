"""Column expressions over label lists (``array<bigint>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDS = "array<bigint>"


def or_empty(ids: Column) -> Column:
    """Null list -> empty list."""
    return F.coalesce(ids, F.array().cast(IDS))


def parse_ids(text: Column) -> Column:
    """``"[1, 2]"`` -> ``[1, 2]``."""
    return F.from_json(text, IDS)


def format_ids(ids: Column) -> Column:
    """``[1, 2]`` -> ``"[1, 2]"``; null elements are left out."""
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))


def union_ids(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(or_empty(a), or_empty(b)))


def intersect_ids(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(or_empty(a), or_empty(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two lists; 0 when both are empty."""
    a, b = or_empty(a), or_empty(b)
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


def jaccard_pick(a: Column, b: Column, threshold: float) -> Column:
    """Union when the lists agree enough, else what they share, else the left list.

    When one list is empty the other one is taken.
    """
    common = intersect_ids(a, b)
    left = F.array_sort(F.array_distinct(or_empty(a)))
    empty = (F.size(or_empty(a)) == 0) | (F.size(or_empty(b)) == 0)
    return (
        F.when(empty | (jaccard(a, b) >= threshold), union_ids(a, b))
        .when(F.size(common) > 0, common)
        .otherwise(left)
    )


def same_ids(a: Column, b: Column) -> Column:
    """Do two lists hold the same set of ids?"""
    a, b = or_empty(a), or_empty(b)
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def first_k_distinct(ids: Column, k: int) -> Column:
    """First k entries, then duplicates dropped in order: may be shorter than k."""
    return F.array_distinct(F.slice(ids, 1, k))
