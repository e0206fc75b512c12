"""Look-ups, merges and filters on map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_key(m: Column, *names: str, default=None) -> Column:
    """The value of the first of several alias keys that is present."""
    found = [F.try_element_at(m, F.lit(n)) for n in names]
    if default is not None:
        found.append(F.lit(default))
    return F.coalesce(*found)


def has_any_key(m: Column, *names: str) -> Column:
    keys = F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))


def merge_later_wins(*maps: Column) -> Column:
    """Merge maps; on equal keys the later map wins, whatever the session's duplicate-key policy."""

    def without(base: Column, names: Column) -> Column:
        return F.map_filter(base, lambda k, v: ~F.array_contains(names, k))

    merged = maps[0]
    for later in maps[1:]:
        merged = F.map_concat(without(merged, F.map_keys(later)), later)
    return merged


def keys_above(m: Column, limit: float) -> Column:
    """Sorted keys whose value is strictly above the limit; a missing map gives an empty array."""
    hits = F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: v > F.lit(limit))))
    return F.coalesce(hits, F.array().cast("array<string>"))


def keys_below(m: Column, limit: float) -> Column:
    hits = F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: v < F.lit(limit))))
    return F.coalesce(hits, F.array().cast("array<string>"))


def map_size(m: Column) -> Column:
    return F.when(m.isNull(), F.lit(0)).otherwise(F.size(m))


def max_value(m: Column) -> Column:
    return F.array_max(F.map_values(m))
