"""Element-wise processes. NULL is NoData: a binary process with a missing side is missing."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int | bool | str | None


def col(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def is_constant(*values: Value) -> bool:
    return not any(isinstance(v, Column) for v in values)


def finite(column: Column) -> Column:
    """NaN results count as missing."""
    return F.when(~F.isnan(column), column)


def compare(op: Callable) -> Callable[[Value, Value], Value]:
    def run(x: Value, y: Value) -> Value:
        if is_constant(x, y):
            return None if x is None or y is None else op(x, y)
        return op(col(x), col(y))

    return run


gt, lt = compare(lambda a, b: a > b), compare(lambda a, b: a < b)
gte, lte = compare(lambda a, b: a >= b), compare(lambda a, b: a <= b)
eq, neq = compare(lambda a, b: a == b), compare(lambda a, b: a != b)


def between(x: Value, low: Value, high: Value, exclude_max: bool = False) -> Column:
    if low is None or high is None:
        raise ValueError("between needs min and max")
    return (col(x) >= col(low)) & ((col(x) < col(high)) if exclude_max else (col(x) <= col(high)))


def truth(x: Value) -> Column:
    """Numbers count as true if they aren't zero."""
    return col(x).cast("boolean")


def not_(x: Value) -> Value:
    return (not x) if is_constant(x) and isinstance(x, bool) else ~truth(x)


def and_(x: Value, y: Value) -> Value:
    """Missing if either side is missing, as for every binary process."""
    return (x and y) if is_constant(x, y) else F.when(col(x).isNotNull() & col(y).isNotNull(), truth(x) & truth(y))


def or_(x: Value, y: Value) -> Value:
    return (x or y) if is_constant(x, y) else F.when(col(x).isNotNull() & col(y).isNotNull(), truth(x) | truth(y))


def xor(x: Value, y: Value) -> Column:
    return truth(x) != truth(y)


def if_(value: Value, accept: Value, reject: Value = None) -> Column:
    """A missing condition takes accept; only a condition of 0 or false rejects."""
    if is_constant(value):
        return col(reject if value is not None and not value else accept)
    return F.when(truth(value) == F.lit(False), col(reject)).otherwise(col(accept))


def divide(x: Value, y: Value) -> Column:
    return F.when(col(y) != 0, col(x).cast("double") / col(y).cast("double"))


def power(base: Value, p: Value) -> Column:
    return finite(F.pow(col(base).cast("double"), col(p).cast("double")))


def normalized_difference(x: Value, y: Value) -> Column:
    return divide(col(x) - col(y), col(x) + col(y))


def clip(x: Value, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def linear_scale_range(x: Value, in_min: float, in_max: float, out_min: float = 0.0, out_max: float = 1.0) -> Column:
    scaled = (col(x) - in_min) / (in_max - in_min) * (out_max - out_min) + out_min
    kept = F.when(col(x).isNotNull(), F.least(F.greatest(scaled, F.lit(float(out_min))), F.lit(float(out_max))))
    if isinstance(out_min, int) and isinstance(out_max, int) and not isinstance(out_min, bool):
        span = "tinyint" if out_min >= 0 and out_max < 128 else "smallint" if out_max < 1 << 15 and out_min >= -(1 << 15) else "int"
        return kept.cast(span)
    return kept


def log(x: Value, base: Value) -> Column:
    return F.ln(col(x).cast("double")) / F.ln(col(base).cast("double"))


def unary(function: Callable[[Column], Column]) -> Callable[[Value], Column]:
    return lambda x: finite(function(col(x).cast("double")))


UNARY: dict[str, Callable[[Value], Column]] = {
    "absolute": lambda x: F.abs(col(x)),
    "ceil": lambda x: F.ceil(col(x)),
    "floor": lambda x: F.floor(col(x)),
    "round": lambda x: F.rint(col(x).cast("double")),
    "int": lambda x: col(x).cast("int"),
    "sqrt": unary(F.sqrt),
    "ln": unary(F.ln),
    "exp": unary(F.exp),
    "arccos": unary(F.acos), "arcsin": unary(F.asin), "arctan": unary(F.atan),
    "cos": unary(F.cos), "cosh": unary(F.cosh), "sin": unary(F.sin), "sinh": unary(F.sinh), "tan": unary(F.tan), "tanh": unary(F.tanh),
    "arsinh": unary(F.asinh), "arcosh": unary(F.acosh), "artanh": unary(F.atanh),
    "sgn": unary(F.signum),
    "is_nodata": lambda x: col(x).isNull(),
    "is_nan": lambda x: col(x).isNull() | F.isnan(col(x).cast("double")),
}
CONSTANTS = {"pi": math.pi, "e": math.e}


def day(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value.replace("Z", "")).replace(tzinfo=None)


def moment(value: Value | datetime) -> Column:
    """A timestamp column from a column, an ISO date or a datetime."""
    return value.cast("timestamp_ntz") if isinstance(value, Column) else F.lit(day(value).isoformat(sep=" ")).cast("timestamp_ntz")


def date_difference(date1, date2, unit: str = "day") -> Column:
    """date2 - date1: whole months; years of 365 days; days, hours and minutes with fractions of the next unit."""
    a, b = moment(date1), moment(date2)

    def whole(name: str) -> Column:
        return F.timestamp_diff(name, a, b)

    units = {
        "year": lambda: whole("DAY") / 365.0, "month": lambda: whole("MONTH").cast("double"), "day": lambda: whole("HOUR") / 24.0,
        "hour": lambda: whole("MINUTE") / 60.0, "minute": lambda: whole("SECOND") / 60.0, "second": lambda: whole("SECOND").cast("double"),
    }
    if unit not in units:
        raise ValueError(f"unknown unit {unit}")
    return units[unit]()


def date_between(x, low, high, exclude_max: bool = False) -> Column:
    return between(moment(x), moment(low), moment(high), exclude_max)


def date_shift(date, value: int, unit: str) -> Column:
    return F.timestamp_add(unit.upper(), F.lit(value), moment(date)).cast("timestamp_ntz")


def date_replace_component(date, value: int, component: str) -> Column:
    at = moment(date)
    parts = {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at), "minute": F.minute(at), "second": F.second(at)}
    if component not in parts:
        raise ValueError(f"unknown component {component}")
    parts[component] = F.lit(value)
    return F.make_timestamp_ntz(*parts.values())


def shifted(value: str, days: int) -> str:
    return (day(value) + timedelta(days=days)).isoformat()
