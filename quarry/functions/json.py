"""Ordered JSON aggregates with nulls kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = {"ignoreNullFields": "false"}


def array_agg(value: Column, *order: Column) -> Column:
    """Aggregate: all values of a group as an array in the order given; null values stay. For groups of bounded size."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda e: e["v"])


def object_agg(key: Column, value: Column, *order: Column) -> Column:
    """Aggregate: a map from each key of a group to its value, keys in order; of a key that repeats the last value by
    ``order`` counts. Null keys are left out, null values stay. For groups of bounded size."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    pairs = F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(key.cast("string").alias("k"), F.struct(*keys, value.alias("v")).alias("e")))))
    last = F.filter(pairs, lambda p, i: ~F.get(pairs, i + 1)["k"].eqNullSafe(p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["e"]["v"])))


def text(value: Column) -> Column:
    """JSON text of a struct, array or map, with null fields and entries."""
    return F.to_json(value, _WHOLE)
