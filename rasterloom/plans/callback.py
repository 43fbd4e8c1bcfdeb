"""Callback sub-graphs compiled to Columns: per-pixel maps, reducers over time, reducers over an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GraphError, UnknownProcess
from ..functions import scalar as S
from ..functions.arrays import present, reduce_array
from .graph import suggest

REDUCERS = ("mean", "min", "max", "sum", "count", "first", "last", "median", "variance", "sd")
_REDUCER_NAMES = {**{r: r for r in REDUCERS}, "var": "variance", "stdev": "sd"}
_LOGIC = ("and", "or", "xor", "not", "eq", "neq", "gt", "gte", "lt", "lte", "between")
SCALARS = sorted({*S.UNARY, *S.BINARY, *S.ALIASES, "log", "round", "clip", "linear_scale_range", "min", "max", *_LOGIC})


def nodes_of(callback: object) -> dict:
    """The node table of a callback, which may be wrapped in ``process_graph``."""
    if isinstance(callback, dict) and "process_graph" in callback:
        callback = callback["process_graph"]
    if not isinstance(callback, dict) or not callback:
        raise GraphError("a callback must be a process graph")
    return callback


def _result(nodes: dict) -> str:
    marked = [k for k, n in nodes.items() if n.get("result")]
    if len(marked) > 1 or not marked and len(nodes) > 1:
        raise GraphError("a callback needs exactly one result node")
    return marked[0] if marked else next(iter(nodes))


def aggregate_reducer(name: str, value: Column) -> Column:
    """A reducer over the valid values of a pixel, in scene order where order matters; NULL if there is none."""
    v = S.finite(value.cast("double"))
    at = F.when(v.isNotNull(), F.col("scene"))
    n = F.count(v)
    kinds: dict[str, Callable[[], Column]] = {
        "mean": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "sum": lambda: F.sum(v),
        "count": lambda: F.nullif(n, F.lit(0)).cast("double"),
        "first": lambda: F.min_by(v, at),
        "last": lambda: F.max_by(v, at),
        "median": lambda: F.median(v),
        "variance": lambda: F.when(n == 1, 0.0).otherwise(F.var_samp(v)),
        "sd": lambda: F.when(n == 1, 0.0).otherwise(F.stddev_samp(v)),
    }
    return kinds[name]()


Hold = Callable[[Column], Column]


def _as_is(value: Column) -> Column:
    return value


class _Compiler:
    def __init__(self, callback: object, parameter: Callable[[str], Column], reducer: Callable[[str], Column] | None, hold: Hold) -> None:
        self.nodes, self.parameter, self.reducer, self.hold = nodes_of(callback), parameter, reducer, hold
        self.made: dict[str, Column] = {}
        self.open: set[str] = set()

    def run(self) -> Column:
        for name in self.nodes:  # every node is checked, those the result does not need as well
            self.node(name)
        return self.node(_result(self.nodes))

    def node(self, name: str) -> Column:
        if name in self.made:
            return self.made[name]
        if name in self.open:
            raise GraphError(f"the callback has a cycle at {name!r}")
        if name not in self.nodes:
            raise GraphError(f"the callback has no node {name!r}")
        self.open.add(name)
        node = self.nodes[name]
        made = self.call(node.get("process_id", ""), node.get("arguments", {}))
        self.made[name] = self.hold(made) if len(self.nodes) > 1 else made
        self.open.discard(name)
        return self.made[name]

    def value(self, arg: object) -> Column:
        if isinstance(arg, dict) and "from_node" in arg:
            return self.node(arg["from_node"])
        if isinstance(arg, dict) and "from_parameter" in arg:
            return self.parameter(arg["from_parameter"])
        if isinstance(arg, bool):
            return F.lit(float(arg))
        if isinstance(arg, int | float):
            return F.lit(float(arg))
        if arg is None:
            return F.lit(None).cast("double")
        raise GraphError(f"not a value in a callback: {arg!r}")

    def arg(self, args: dict, *names: str, default: object = ...) -> Column:
        for n in names:
            if n in args:
                return self.value(args[n])
        data = args.get("data")
        if isinstance(data, list) and names[0] in ("x", "y", "base", "p") and len(data) == 2:
            return self.value(data[names[0] in ("y", "p")])
        if default is ...:
            raise GraphError(f"missing argument {names[0]!r}")
        return self.value(default)

    def call(self, process: str, args: dict) -> Column:
        if self.reducer and process in _REDUCER_NAMES:
            data = args.get("data")
            if not (isinstance(data, dict) and "from_parameter" in data):
                raise GraphError(f"{process} must reduce the callback's parameter")
            return self.reducer(_REDUCER_NAMES[process])
        process = S.ALIASES.get(process, process)
        a = lambda *names, **k: self.arg(args, *names, **k)
        number = lambda c: c.cast("double")
        if process in S.UNARY:
            return S.UNARY[process](a("x", "p", "data"))
        if process == "power":
            return S.BINARY[process](a("base", "x"), a("p", "y"))
        if process == "arctan2":
            return S.BINARY[process](a("y"), a("x"))
        if process in S.BINARY:
            return S.BINARY[process](a("x"), a("y"))
        if process == "log":
            return S.log(a("x"), a("base"))
        if process == "round":
            return S.rounded(a("x"), a("p", default=0))
        if process == "clip":
            low, high = args.get("min"), args.get("max")
            if isinstance(low, int | float) and isinstance(high, int | float) and low > high:
                raise GraphError("clip: min is above max")
            return S.clipped(a("x"), a("min"), a("max"))
        if process == "linear_scale_range":
            low, high = args.get("inputMin"), args.get("inputMax")
            if low is not None and low == high:
                raise GraphError("linear_scale_range: the input range is empty")
            return S.linear_scale_range(a("x"), a("inputMin"), a("inputMax"), a("outputMin", default=0), a("outputMax", default=1))
        if process in ("min", "max"):
            x, y = a("x"), a("y")
            return F.when(x.isNotNull() & y.isNotNull(), (F.least if process == "min" else F.greatest)(x, y))
        if process in S.COMPARE:
            return number(S.COMPARE[process](a("x"), a("y")))
        if process in ("eq", "neq"):
            same = S.equal(a("x"), a("y"), a("delta") if "delta" in args else None)
            return number(same if process == "eq" else ~same)
        if process == "between":
            return number(S.between(a("x"), a("min"), a("max"), bool(args.get("exclude_max"))))
        if process in ("and", "or", "xor"):
            x, y = a("x") != 0, a("y") != 0
            return number({"and": x & y, "or": x | y, "xor": x != y}[process])
        if process == "not":
            return number(a("x") == 0)
        raise UnknownProcess(f"unknown process {process!r} in a callback{suggest(process, [*SCALARS, *REDUCERS])}")


def compile_apply(callback: object, pixel: Column, hold: Hold = _as_is) -> Column:
    """Every parameter is the pixel; NULL in or a failing step gives NULL. ``hold`` gives columns for shared values."""
    pixel = hold(pixel)
    made = hold(_Compiler(callback, lambda _: pixel, None, hold).run())
    return F.when(pixel.isNotNull(), S.finite(made.cast("double")))


def _no_array(_: str) -> Column:
    raise GraphError("a reducer's data is an array; only reducers take it")


def compile_temporal(callback: object, value: Column, aggregate: Hold, hold: Hold = _as_is) -> Column:
    """``aggregate`` takes an aggregate and gives the column of the grouped rows that has it."""
    return S.finite(hold(_Compiler(callback, _no_array, lambda r: aggregate(aggregate_reducer(r, value)), hold).run()))


def compile_array(callback: object, values: list[Column], hold: Hold = _as_is) -> Column:
    """A reducer over an array of columns, row by row; missing and non-finite values are left out."""
    own = hold(present(F.array(*(S.finite(hold(v.cast("double"))) for v in values))))
    return S.finite(hold(_Compiler(callback, _no_array, lambda r: hold(reduce_array(r, own)), hold).run()))
