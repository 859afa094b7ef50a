"""Process graphs: JSON -> columns.

A graph maps node names to {"process_id", "arguments", "result"?}. Arguments are constants, lists, {"from_node": name} or
{"from_parameter": name}. A callback runs in one of two scopes:

* Bands: `data` is the list of a cell's band columns; reducers fold the list.
* Series: `data` is one band over time; reducers become aggregates of the group, element-wise processes stay
  element-wise before a reducer and act on its result behind it.

Constants are folded in Python; everything else becomes a Catalyst expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import arrays, scalar, series


class GraphError(ValueError):
    """The graph can't be compiled."""


@dataclass
class Bands:
    """A list of columns with optional labels."""

    columns: list
    labels: list[str] | None = None


@dataclass
class Series:
    """One value over the rows of a group, in the order of `order`."""

    column: Column
    order: Column


@dataclass
class Scope:
    parameters: dict = field(default_factory=dict)
    #: Where NoData flags of reducers aren't given.
    ignore_nodata: bool = True


BINARY: dict[str, Callable] = {
    "gt": scalar.gt, "lt": scalar.lt, "gte": scalar.gte, "lte": scalar.lte, "eq": scalar.eq, "neq": scalar.neq,
    "and": scalar.and_, "or": scalar.or_, "xor": scalar.xor,
    "add": lambda x, y: scalar.col(x) + scalar.col(y), "subtract": lambda x, y: scalar.col(x) - scalar.col(y),
    "multiply": lambda x, y: scalar.col(x) * scalar.col(y), "divide": scalar.divide,
    "normalized_difference": scalar.normalized_difference,
    "mod": lambda x, y: scalar.col(x) % scalar.col(y), "arctan2": lambda x, y: F.atan2(scalar.col(x), scalar.col(y)),
}
FOLDS = {"add", "subtract", "multiply", "divide", "and", "or", "xor"}
BAND_REDUCERS: dict[str, Callable] = {
    "sum": arrays.total, "mean": arrays.mean, "median": arrays.median, "variance": arrays.variance, "sd": arrays.sd,
    "max": lambda c, i: arrays.extreme(c, True, i), "min": lambda c, i: arrays.extreme(c, False, i),
    "first": arrays.first, "last": arrays.last,
    "product": lambda c, i: arrays.product(c), "all": lambda c, i: arrays.all_(c), "any": lambda c, i: arrays.any_(c),
}


def _columns(value) -> list:
    return value.columns if isinstance(value, Bands) else value if isinstance(value, list) else [value]


def _each(function: Callable, value):
    """function over one value, each of a list, or a series."""
    if isinstance(value, Bands):
        return Bands([function(c) for c in value.columns], value.labels)
    if isinstance(value, list):
        return Bands([function(c) for c in value])
    if isinstance(value, Series):
        return Series(function(value.column), value.order)
    return function(value)


def _pairs(function: Callable, x, y):
    """function over two values; lists of one go with lists of any length."""
    if isinstance(x, Series) or isinstance(y, Series):
        order = (x if isinstance(x, Series) else y).order
        return Series(function(x.column if isinstance(x, Series) else x, y.column if isinstance(y, Series) else y), order)
    if isinstance(x, Bands | list) or isinstance(y, Bands | list):
        a, b = _columns(x), _columns(y)
        if len(a) != len(b) and 1 not in (len(a), len(b)):
            raise GraphError(f"lists of {len(a)} and {len(b)} values don't go together")
        n = max(len(a), len(b))
        labels = x.labels if isinstance(x, Bands) and len(a) == n else y.labels if isinstance(y, Bands) else None
        return Bands([function(a[i % len(a)], b[i % len(b)]) for i in range(n)], labels)
    return function(x, y)


class Compiler:
    def __init__(self, graph: dict, scope: Scope):
        self.graph, self.scope, self.done = graph, scope, {}

    def run(self):
        results = [n for n, node in self.graph.items() if node.get("result")]
        if len(results) != 1:
            raise GraphError("a graph has exactly one result node")
        return self.node(results[0])

    def node(self, name: str):
        if name not in self.graph:
            raise GraphError(f"no node {name}")
        if name not in self.done:
            self.done[name] = None
            self.done[name] = self.apply(self.graph[name])
        elif self.done[name] is None:
            raise GraphError(f"node {name} depends on itself")
        return self.done[name]

    def value(self, given):
        if isinstance(given, dict):
            if "from_node" in given:
                return self.node(given["from_node"])
            if "from_parameter" in given:
                name = given["from_parameter"]
                if name not in self.scope.parameters:
                    raise GraphError(f"unknown parameter {name}")
                return self.scope.parameters[name]
            return given
        if isinstance(given, list):
            return [self.value(v) for v in given]
        return given

    def argument(self, args: dict, *names: str, default=...):
        for name in names:
            if name in args:
                return self.value(args[name])
        if default is not ...:
            return default
        raise GraphError(f"argument {names[0]} is missing")

    def child(self, callback: dict, **parameters):
        return Compiler(callback["process_graph"], Scope(self.scope.parameters | parameters, self.scope.ignore_nodata)).run()

    def apply(self, node: dict):
        name, args = node["process_id"], node.get("arguments", {})
        arg = lambda *names, **kw: self.argument(args, *names, **kw)
        if name in scalar.CONSTANTS:
            return scalar.CONSTANTS[name]
        if name in BINARY and "x" in args:
            return _pairs(BINARY[name], arg("x"), arg("y"))
        if name in FOLDS and ("data" in args or "expressions" in args):
            out, *rest = _columns(arg("data", "expressions"))
            for value in rest:
                out = BINARY[name](out, value)
            return out
        if name in scalar.UNARY or name == "abs":
            return _each(scalar.UNARY["absolute" if name == "abs" else name], arg("p" if name == "exp" else "x", "x"))
        special = getattr(self, f"do_{name}", None)
        if special:
            return special(args, arg)
        if name in BAND_REDUCERS or name in series.REDUCERS:
            return self.reduce(name, arg("data"), arg("ignore_nodata", default=self.scope.ignore_nodata))
        raise GraphError(f"unknown process {name}")

    def reduce(self, name: str, data, ignore: bool):
        if isinstance(data, Series):
            return series.reducer(name, data.column, data.order, ignore)
        if all(scalar.is_constant(c) for c in _columns(data)) and name in ("any", "all"):
            return {"any": any, "all": all}[name](_columns(data))
        return BAND_REDUCERS[name]([scalar.col(c) for c in _columns(data)], ignore)

    def do_not(self, args, arg):
        return _each(scalar.not_, arg("x", "expression"))

    def do_between(self, args, arg):
        return _each(lambda c: scalar.between(c, arg("min"), arg("max"), arg("exclude_max", default=False)), arg("x"))

    def do_if(self, args, arg):
        value, accept, reject = arg("value"), arg("accept"), arg("reject", default=None)
        if isinstance(value, Bands | Series):
            return _each(lambda c: scalar.if_(c, accept, reject), value)
        if isinstance(accept, Bands | list):
            other = _columns(reject) if reject is not None else [None]
            return Bands([scalar.if_(value, a, other[i % len(other)]) for i, a in enumerate(_columns(accept))])
        if isinstance(accept, Series):
            return Series(scalar.if_(value, accept.column, reject.column if isinstance(reject, Series) else reject), accept.order)
        return scalar.if_(value, accept, reject)

    def do_power(self, args, arg):
        return _pairs(scalar.power, arg("base"), arg("p"))

    def do_log(self, args, arg):
        return _each(lambda c: scalar.log(c, arg("base")), arg("x"))

    def do_clip(self, args, arg):
        return _each(lambda c: scalar.clip(c, arg("min"), arg("max")), arg("x"))

    def do_linear_scale_range(self, args, arg):
        return _each(lambda c: scalar.linear_scale_range(c, arg("inputMin"), arg("inputMax"), arg("outputMin", default=0.0), arg("outputMax", default=1.0)), arg("x"))

    def do_inspect(self, args, arg):
        print(f"{args.get('level', 'info')}: {args.get('message', '')} {args.get('code', '')}")
        return arg("data")

    def do_count(self, args, arg):
        data, condition = arg("data"), args.get("condition")
        if isinstance(condition, dict):
            if isinstance(data, Series):
                held = self.child(condition, x=data.column, value=data.column)
                return F.count_if(scalar.truth(held))
            held = [scalar.truth(self.child(condition, x=c, value=c)) for c in _columns(data)]
            return sum((F.coalesce(h, F.lit(False)).cast("int") for h in held), F.lit(0))
        if isinstance(data, Series):
            return series.reducer("count_all" if condition is True else "count", data.column, data.order)
        return arrays.count(_columns(data), condition is True)

    def do_quantiles(self, args, arg):
        data, wanted = arg("data"), arg("probabilities", "q")
        wanted = series.even_probabilities(wanted) if isinstance(wanted, int) else wanted
        ignore = arg("ignore_nodata", default=self.scope.ignore_nodata)
        if isinstance(data, Series):
            whole = series.quantiles(data.column, wanted)
            whole = whole if ignore else F.when(F.count(data.column) == F.count(F.lit(1)), whole)
            return Bands([whole[i] for i in range(len(wanted))])
        return Bands([arrays.quantile(_columns(data), p, ignore) for p in wanted])

    def do_array_element(self, args, arg):
        data = arg("data")
        if isinstance(data, Series):
            raise GraphError("array_element of a time series isn't supported; use first or last")
        columns = _columns(data)
        if "label" in args:
            labels = (data.labels if isinstance(data, Bands) else None) or self.scope.parameters.get("array_labels") or []
            if arg("label") not in labels:
                raise GraphError(f"no label {arg('label')} in {labels}")
            return columns[labels.index(arg("label"))]
        index = arg("index")
        if not 0 <= index < len(columns):
            raise IndexError(f"array_element {index} is out of range for {len(columns)} values")
        return columns[index]

    def do_array_modify(self, args, arg):
        return Bands(arrays.array_modify(_columns(arg("data")), _columns(arg("values")), arg("index"), arg("length", default=0)))

    def do_array_find(self, args, arg):
        return arrays.array_find(_columns(arg("data")), arg("value"), arg("reverse", default=False))

    def do_array_interpolate_linear(self, args, arg):
        data = arg("data")
        return Bands(arrays.array_interpolate_linear(_columns(data)), data.labels if isinstance(data, Bands) else None)

    def do_array_concat(self, args, arg):
        return Bands([*_columns(arg("array1")), *_columns(arg("array2"))])

    def do_array_append(self, args, arg):
        return Bands([*_columns(arg("data")), arg("value")])

    def do_array_create(self, args, arg):
        return Bands(_columns(arg("data", default=[])) * arg("repeat", default=1))

    def do_array_apply(self, args, arg):
        data = arg("data")
        labels = data.labels if isinstance(data, Bands) else None
        columns = _columns(data)
        made = [self.child(args["process"], x=c, index=i, data=data, label=labels[i] if labels else None, **{"parent.data": data}) for i, c in enumerate(columns)]
        return Bands(made, labels)

    def do_date_difference(self, args, arg):
        return scalar.date_difference(arg("date1"), arg("date2"), arg("unit", default="day"))

    def do_date_between(self, args, arg):
        return scalar.date_between(arg("x"), arg("min"), arg("max"), arg("exclude_max", default=False))

    def do_date_shift(self, args, arg):
        return scalar.date_shift(arg("date"), arg("value"), arg("unit"))

    def do_date_replace_component(self, args, arg):
        return scalar.date_replace_component(arg("date"), arg("value"), arg("component"))


def compile_bands(graph: dict, columns: list[Column], labels: list[str] | None = None, **parameters) -> list[Column]:
    """Result columns of a callback over band columns."""
    data = Bands(columns, labels)
    found = Compiler(graph, Scope({"data": data, "x": data if len(columns) > 1 else columns[0], "array_labels": labels} | parameters)).run()
    return [scalar.col(c) for c in _columns(found)]


def compile_series(graph: dict, column: Column, order: Column, **parameters) -> list[Column]:
    """Aggregates (or element-wise columns) of a callback over one band in time."""
    found = Compiler(graph, Scope({"data": Series(column, order), "x": Series(column, order)} | parameters)).run()
    return [found.column] if isinstance(found, Series) else [scalar.col(c) for c in _columns(found)]


def single(process_id: str, **arguments) -> dict:
    """A graph of one process over `data`."""
    return {"only": {"process_id": process_id, "arguments": {"data": {"from_parameter": "data"}} | arguments, "result": True}}
