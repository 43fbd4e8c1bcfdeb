"""Array processes as Column expressions over ARRAY<DOUBLE>; elements may be NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPEAT_CAP = 10_000_000


def array_element(data: Column, index: int, return_nodata: bool = False) -> Column:
    """From 0. Out of bounds: NULL with ``return_nodata``, else an error when the row is read."""
    if index < 0:
        raise ValueError("index must not be negative")
    got = F.get(data, F.lit(index))
    return got if return_nodata else F.when(F.size(data) > index, got).otherwise(F.raise_error(F.lit(f"no element {index}")).cast("double"))


def array_create(data: Column, repeat: int = 1) -> Column:
    repeat = max(repeat, 1)
    over = F.size(data).cast("long") * repeat > REPEAT_CAP
    return F.when(over, F.raise_error(F.lit("the array is too long")).cast("array<double>")).otherwise(F.flatten(F.array_repeat(data, repeat)))


def array_concat(array1: Column, array2: Column) -> Column:
    return F.concat(array1, array2)


def array_append(data: Column, value: Column) -> Column:
    return F.array_append(data, value)


def array_contains(data: Column, value: Column) -> Column:
    """NULL matches NULL; never NULL for an array that is there."""
    return F.exists(data, lambda x: x.eqNullSafe(value))


def array_find(data: Column, value: Column) -> Column:
    """The first match, from 0, or NULL."""
    return F.nullif(F.array_position(data, value), F.lit(0)) - 1


def count(data: Column) -> Column:
    return F.size(present(data))


def present(data: Column) -> Column:
    return F.filter(data, lambda x: x.isNotNull())


def order(data: Column, asc: bool = True, nodata: bool | None = None) -> Column:
    """The positions in sorted order, stable either way. NULLs: dropped, or last (``nodata`` True) or first (False)."""
    at = F.transform(data, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    full = F.filter(at, lambda e: e["v"].isNotNull())
    keyed = F.transform(full, lambda e: F.struct((e["v"] if asc else -e["v"]).alias("k"), e["i"].alias("i")))
    sorted_ = F.transform(F.array_sort(keyed), lambda e: e["i"])
    if nodata is None:
        return sorted_
    empty = F.transform(F.filter(at, lambda e: e["v"].isNull()), lambda e: e["i"])
    return F.concat(sorted_, empty) if nodata else F.concat(empty, sorted_)


def sort(data: Column, asc: bool = True, nodata: bool | None = None) -> Column:
    """The values in sorted order, NULLs as in ``order``."""
    sorted_ = F.sort_array(present(data), asc)
    if nodata is None:
        return sorted_
    empty = F.filter(data, lambda x: x.isNull())
    return F.concat(sorted_, empty) if nodata else F.concat(empty, sorted_)


def reduce_array(name: str, own: Column) -> Column:
    """A reducer over an array without NULLs; NULL if it is empty."""
    n = F.size(own)
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    mean = total / n
    spread = F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    variance = F.when(n == 1, 0.0).otherwise(F.try_divide(spread, n - 1))
    ranked = F.array_sort(own)
    middle = (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2
    kinds = {
        "mean": lambda: mean,
        "min": lambda: F.array_min(own),
        "max": lambda: F.array_max(own),
        "sum": lambda: total,
        "count": lambda: n.cast("double"),
        "first": lambda: F.get(own, F.lit(0)),
        "last": lambda: F.get(own, n - 1),
        "median": lambda: middle,
        "variance": lambda: variance,
        "sd": lambda: F.sqrt(variance),
    }
    return F.when(n > 0, kinds[name]())
