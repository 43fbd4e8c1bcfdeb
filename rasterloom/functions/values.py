"""Scalar and array processes on plain values, as they stand at the top level of a graph."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any


def _number(v: Any) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float):
        raise ValueError(f"not a number: {v!r}")
    return float(v)


def _boolean(v: Any) -> bool:
    if not isinstance(v, bool):
        raise ValueError(f"not a boolean: {v!r}")
    return v


def _array(v: Any) -> list:
    if not isinstance(v, list):
        raise ValueError("not an array")
    return v


def _or_nan(f: Callable[..., float]) -> Callable[..., float]:
    def run(*values: float) -> float:
        try:
            return float(f(*values))
        except (ValueError, OverflowError, ZeroDivisionError):
            return math.nan

    return run


def _unary(f: Callable[[float], float], parameter: str = "x") -> Callable[..., float]:
    safe = _or_nan(f)
    return (lambda p: safe(_number(p))) if parameter == "p" else (lambda x: safe(_number(x)))


def divide(x: Any, y: Any) -> float:
    if _number(y) == 0:
        raise ValueError("division by zero")
    return _number(x) / _number(y)


def mod(x: Any, y: Any) -> float:
    if _number(y) == 0:
        return math.nan
    return _number(x) - _number(y) * math.floor(_number(x) / _number(y))


def round_(x: Any, p: Any = 0) -> float:
    scale = 10.0 ** int(p or 0)
    return round(_number(x) * scale) / scale


def log(x: Any, base: Any) -> float:
    if _number(base) <= 0 or base == 1:
        raise ValueError("the base must be positive and not 1")
    return _or_nan(lambda a, b: math.log(a) / math.log(b))(_number(x), _number(base))


def clip(x: Any, min: Any, max: Any) -> float:  # noqa: A002
    if _number(min) > _number(max):
        raise ValueError("min is above max")
    low, high, v = _number(min), _number(max), _number(x)
    return low if v < low else high if v > high else v


def normalized_difference(x: Any, y: Any) -> float:
    return divide(_number(x) - _number(y), _number(x) + _number(y))


def eq(x: Any, y: Any, delta: Any = None, case_sensitive: bool = True) -> bool:
    if isinstance(x, str) and isinstance(y, str):
        return x == y if case_sensitive else x.lower() == y.lower()
    return _number(x) == _number(y) if delta is None else abs(_number(x) - _number(y)) <= _number(delta)


def between(x: Any, min: Any, max: Any, exclude_max: bool = False) -> bool:  # noqa: A002
    return _number(min) <= _number(x) and (_number(x) < _number(max) if exclude_max else _number(x) <= _number(max))


def _same(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a == b


def array_element(data: list, index: int | None = None, label: Any = None, return_nodata: bool = False) -> Any:
    if index is None or isinstance(index, bool) or int(index) < 0:
        raise ValueError("an index from 0 is needed; labels are not supported")
    if int(index) < len(_array(data)):
        return data[int(index)]
    if return_nodata:
        return None
    raise ValueError(f"no element {index}")


def array_create(data: Any = None, repeat: int = 1) -> list:
    own = [] if data is None else data if isinstance(data, list) else [data]
    if len(own) * max(int(repeat), 1) > 10_000_000:
        raise ValueError("the array is too long")
    return own * max(int(repeat), 1)


def array_find(data: list, value: Any) -> int | None:
    return next((i for i, v in enumerate(_array(data)) if _same(v, value)), None)


def order(data: list, asc: bool = True, nodata: bool | None = None) -> list[int]:
    full = [i for i, v in enumerate(_array(data)) if isinstance(v, int | float) and not isinstance(v, bool)]
    empty = [i for i in range(len(data)) if i not in set(full)]
    own = sorted(full, key=lambda i: data[i] if asc else -data[i])
    return own if nodata is None else own + empty if nodata else empty + own


def sort(data: list, asc: bool = True, nodata: bool | None = None) -> list:
    return [data[i] for i in order(data, asc, nodata)]


PLAIN: dict[str, Callable[..., Any]] = {
    "add": lambda x, y: _number(x) + _number(y),
    "subtract": lambda x, y: _number(x) - _number(y),
    "multiply": lambda x, y: _number(x) * _number(y),
    "divide": divide,
    "absolute": _unary(abs),
    "sqrt": _unary(math.sqrt),
    "power": lambda base, p: _or_nan(math.pow)(_number(base), _number(p)),
    "exp": _unary(math.exp, "p"),
    "ln": _unary(math.log),
    "log": log,
    "sgn": _unary(lambda v: (v > 0) - (v < 0)),
    "floor": _unary(math.floor),
    "ceil": _unary(math.ceil),
    "int": _unary(math.trunc),
    "round": round_,
    "mod": mod,
    "clip": clip,
    "normalized_difference": normalized_difference,
    "cos": _unary(math.cos),
    "sin": _unary(math.sin),
    "tan": _unary(math.tan),
    "arccos": _unary(math.acos),
    "arcsin": _unary(math.asin),
    "arctan": _unary(math.atan),
    "arctan2": lambda y, x: math.atan2(_number(y), _number(x)),
    "eq": eq,
    "neq": lambda x, y, delta=None, case_sensitive=True: not eq(x, y, delta, case_sensitive),
    "gt": lambda x, y: _number(x) > _number(y),
    "gte": lambda x, y: _number(x) >= _number(y),
    "lt": lambda x, y: _number(x) < _number(y),
    "lte": lambda x, y: _number(x) <= _number(y),
    "between": between,
    "and": lambda x, y: _boolean(x) and _boolean(y),
    "or": lambda x, y: _boolean(x) or _boolean(y),
    "xor": lambda x, y: _boolean(x) != _boolean(y),
    "not": lambda x: not _boolean(x),
    "array_element": array_element,
    "array_create": array_create,
    "array_concat": lambda array1, array2: _array(array1) + _array(array2),
    "array_append": lambda data, value: [*_array(data), value],
    "array_contains": lambda data, value: array_find(data, value) is not None,
    "array_find": array_find,
    "count": lambda data, condition=None: sum(v is not None for v in _array(data)),
    "order": order,
    "sort": sort,
}
