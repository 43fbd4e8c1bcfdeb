"""Scalar processes as Column expressions. NULL is the only "no data"; nothing here yields NaN or infinity, or raises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def _real(c: Column) -> Column:
    return c.cast("double")


def truncated(x: Column) -> Column:
    return _real(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def rounded(x: Column, p: Column) -> Column:
    """To p decimals, halves to even."""
    scale = F.pow(F.lit(10.0), p)
    return finite(F.rint(x * scale) / scale)


def clipped(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(x, low), high))


def modulo(x: Column, y: Column) -> Column:
    """The sign of the divisor; NULL for divisor 0."""
    return x - y * F.floor(F.try_divide(x, y))


def between(x: Column, low: Column, high: Column, exclude_max: bool = False) -> Column:
    return (x >= low) & ((x < high) if exclude_max else (x <= high))


def equal(x: Column, y: Column, delta: Column | None = None) -> Column:
    return x == y if delta is None else F.abs(x - y) <= delta


#: name: (parameters, expression)
UNARY: dict[str, Callable[[Column], Column]] = {
    "absolute": F.abs,
    "sqrt": lambda x: finite(F.sqrt(x)),
    "exp": lambda x: finite(F.exp(x)),
    "ln": lambda x: finite(F.ln(x)),
    "sgn": F.signum,
    "floor": lambda x: _real(F.floor(x)),
    "ceil": lambda x: _real(F.ceil(x)),
    "int": truncated,
    "cos": lambda x: finite(F.cos(x)),
    "sin": lambda x: finite(F.sin(x)),
    "tan": lambda x: finite(F.tan(x)),
    "arccos": lambda x: finite(F.acos(x)),
    "arcsin": lambda x: finite(F.asin(x)),
    "arctan": F.atan,
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: finite(x + y),
    "subtract": lambda x, y: finite(x - y),
    "multiply": lambda x, y: finite(x * y),
    "divide": lambda x, y: finite(F.try_divide(x, y)),
    "power": lambda base, p: finite(F.pow(base, p)),
    "mod": modulo,
    "normalized_difference": lambda x, y: finite(F.try_divide(x - y, x + y)),
    "arctan2": F.atan2,
}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda x, y: x > y,
    "gte": lambda x, y: x >= y,
    "lt": lambda x, y: x < y,
    "lte": lambda x, y: x <= y,
}
#: other names that callbacks may use
ALIASES = {"abs": "absolute", "sign": "sgn"}


def log(x: Column, base: Column) -> Column:
    """NULL for x <= 0 and for a base that is 1 or not positive."""
    return F.when((base > 0) & (base != 1), finite(F.try_divide(F.ln(x), F.ln(base))))


def linear_scale_range(x: Column, in_min: Column, in_max: Column, out_min: Column, out_max: Column) -> Column:
    """No clamping; NULL if the input range is empty."""
    return finite(F.try_divide(x - in_min, in_max - in_min) * (out_max - out_min) + out_min)
