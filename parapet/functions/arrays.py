"""Array and map functions with their own null rules: what a null array gives is stated for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_item(a: Column, f: Callable[[Column], Column]) -> Column:
    """Null array -> null; true wins, else a null -> null."""
    return F.exists(a, f)


def all_items(a: Column, f: Callable[[Column], Column]) -> Column:
    """Null array -> true."""
    return F.when(a.isNull(), F.lit(True)).otherwise(F.forall(a, f))


def keep(a: Column, f: Callable[[Column], Column], kind: str) -> Column:
    """Items for which f is exactly true; null array -> empty."""
    return F.coalesce(F.filter(a, f), F.array().cast(kind))


def each(a: Column, f: Callable[[Column], Column]) -> Column:
    """Null array -> null."""
    return F.transform(a, f)


def unique(a: Column, kind: str, key: Callable[[Column], Column] | None = None) -> Column:
    """First of each value (or key); null counts as a value; null array -> empty."""
    if key is None:
        return F.coalesce(F.array_distinct(a), F.array().cast(kind))
    marked = F.transform(a, lambda x: F.struct(x.alias("x"), F.struct(key(x).alias("k")).alias("k")))
    first = F.aggregate(
        marked,
        F.array().cast(f"array<struct<x:{kind.removeprefix('array<').removesuffix('>')},k:struct<k:string>>>"),
        lambda acc, m: F.when(F.exists(acc, lambda o: o["k"]["k"].eqNullSafe(m["k"]["k"].cast("string"))), acc).otherwise(F.array_append(acc, F.struct(m["x"].alias("x"), F.struct(m["k"]["k"].cast("string").alias("k")).alias("k")))),
        lambda acc: F.transform(acc, lambda o: o["x"]),
    )
    return F.coalesce(first, F.array().cast(kind))


def flat(a: Column, kind: str) -> Column:
    """One level of nesting removed; null inner arrays are skipped; null -> empty."""
    return F.coalesce(F.flatten(F.filter(a, lambda x: x.isNotNull())), F.array().cast(kind))


def total(a: Column, f: Callable[[Column], Column] | None = None, kind: str = "bigint") -> Column:
    """Nulls are skipped; null or empty array -> 0."""
    items = F.transform(a, f) if f else a
    return F.coalesce(F.aggregate(items, F.lit(0).cast(kind), lambda s, x: s + F.coalesce(x.cast(kind), F.lit(0).cast(kind))), F.lit(0).cast(kind))


def share(a: Column, f: Callable[[Column], Column]) -> Column:
    """Part of the items for which f is true; nulls count below the line; null or empty array -> null."""
    return F.try_divide(F.size(F.filter(a, lambda x: F.coalesce(f(x), F.lit(False)))).cast("double"), F.when(a.isNotNull(), F.size(a)).cast("double"))


def length(x: Column, text: bool = False) -> Column:
    return F.length(x) if text else F.when(x.isNotNull(), F.size(x))


def item(a: Column, i: int) -> Column:
    """Null below zero and out of range."""
    return F.get(a, F.lit(i)) if i >= 0 else F.get(a, F.lit(-1))


def cut(a: Column, low: int, high: int) -> Column:
    """Items low..high-1, bounds clamped."""
    return F.slice(a, F.lit(max(low, 0) + 1), F.lit(max(high - max(low, 0), 0)))


def keys(m: Column) -> Column:
    """Sorted; null map -> empty."""
    return F.coalesce(F.array_sort(F.map_keys(m)), F.array().cast("array<string>"))


def values(m: Column) -> Column:
    """In the order of the sorted keys."""
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.try_element_at(m, k))


smallest, largest, first_known = F.least, F.greatest, F.coalesce
