"""Reducers over rows: aggregates for reduce and aggregate processes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(value: Column, v: Column, ignore_nodata: bool) -> Column:
    return value if ignore_nodata else F.when(F.count(v) == F.count(F.lit(1)), value)


def _ordered(v: Column, order: Column, ignore_nodata: bool, latest: bool) -> Column:
    pick = F.max_by if latest else F.min_by
    if ignore_nodata:
        return pick(v, F.when(v.isNotNull(), order))
    return pick(F.struct(v.alias("v")), order)["v"]


def product(v: Column) -> Column:
    """Missing as soon as one value is missing."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.product(v))


#: name -> function(value, order, ignore_nodata)
REDUCERS: dict[str, Callable[[Column, Column, bool], Column]] = {
    "max": lambda v, o, i: _strict(F.max(v), v, i),
    "min": lambda v, o, i: _strict(F.min(v), v, i),
    "mean": lambda v, o, i: _strict(F.avg(v), v, i),
    "sum": lambda v, o, i: _strict(F.sum(v), v, i),
    "product": lambda v, o, i: product(v),
    "variance": lambda v, o, i: _strict(F.var_samp(v), v, i),
    "sd": lambda v, o, i: _strict(F.stddev_samp(v), v, i),
    "median": lambda v, o, i: _strict(F.median(v), v, i),
    "count": lambda v, o, i: F.nullif(F.count(v), F.lit(0)),
    "count_all": lambda v, o, i: F.count(F.lit(1)),
    "first": lambda v, o, i: _ordered(v, o, i, False),
    "last": lambda v, o, i: _ordered(v, o, i, True),
    "all": lambda v, o, i: F.when(F.count(v) == F.count(F.lit(1)), F.bool_and(v.cast("boolean"))),
    "any": lambda v, o, i: F.when(F.count(v) == F.count(F.lit(1)), F.bool_or(v.cast("boolean"))),
    "skewness": lambda v, o, i: F.skewness(v),
    "kurtosis": lambda v, o, i: F.kurtosis(v),
}


def reducer(name: str, v: Column, order: Column, ignore_nodata: bool = True) -> Column:
    if name not in REDUCERS:
        raise ValueError(f"unknown reducer {name}")
    return REDUCERS[name](v, order, ignore_nodata)


def quantiles(v: Column, probabilities: list[float]) -> Column:
    """An array, by linear interpolation."""
    return F.percentile(v, F.array(*map(F.lit, probabilities)))


def even_probabilities(q: int) -> list[float]:
    return [i / q for i in range(1, q)]
