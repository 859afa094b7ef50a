"""Reducers and array processes over a list of band columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_missing(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (c.isNull() for c in cols))


def _count(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cols))


def _strict(value: Column, cols: list[Column], ignore_nodata: bool) -> Column:
    return value if ignore_nodata else F.when(~_any_missing(cols), value)


def total(cols: list[Column], ignore_nodata: bool = True) -> Column:
    added = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in cols))
    return _strict(F.when(_count(cols) > 0, added), cols, ignore_nodata)


def extreme(cols: list[Column], largest: bool, ignore_nodata: bool = True) -> Column:
    found = cols[0] if len(cols) == 1 else (F.greatest if largest else F.least)(*cols)
    return _strict(found, cols, ignore_nodata)


def mean(cols: list[Column], ignore_nodata: bool = True) -> Column:
    return _strict(total(cols).cast("double") / F.nullif(_count(cols), F.lit(0)), cols, ignore_nodata)


def variance(cols: list[Column], ignore_nodata: bool = True) -> Column:
    centre = mean(cols)
    squares = reduce(lambda a, b: a + b, (F.coalesce((c - centre) * (c - centre), F.lit(0.0)) for c in cols))
    return _strict(F.when(_count(cols) > 1, squares / (_count(cols) - 1)), cols, ignore_nodata)


def sd(cols: list[Column], ignore_nodata: bool = True) -> Column:
    return F.sqrt(variance(cols, ignore_nodata))


def known(cols: list[Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(c.cast("double") for c in cols))))


def quantile(cols: list[Column], p: float, ignore_nodata: bool = True) -> Column:
    """Linear interpolation between the neighbouring values."""
    values = known(cols)
    at = (F.size(values) - 1) * F.lit(float(p))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.try_element_at(values, low + 1), F.try_element_at(values, high + 1)
    return _strict(F.when(F.size(values) > 0, a + (b - a) * (at - low)), cols, ignore_nodata)


def median(cols: list[Column], ignore_nodata: bool = True) -> Column:
    return quantile(cols, 0.5, ignore_nodata)


def count(cols: list[Column], every: bool = False) -> Column:
    """Valid values; none at all gives missing, as reducers aren't called for a cell without values."""
    return F.lit(len(cols)) if every else F.nullif(_count(cols), F.lit(0))


def first(cols: list[Column], ignore_nodata: bool = True) -> Column:
    return F.coalesce(*cols) if ignore_nodata else cols[0]


def last(cols: list[Column], ignore_nodata: bool = True) -> Column:
    return first(cols[::-1], ignore_nodata)


def product(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, cols)


def all_(cols: list[Column]) -> Column:
    return F.when(~_any_missing(cols), reduce(lambda a, b: a & b, (c.cast("boolean") for c in cols)))


def any_(cols: list[Column]) -> Column:
    return F.when(~_any_missing(cols), reduce(lambda a, b: a | b, (c.cast("boolean") for c in cols)))


def array_find(cols: list[Column], value: Column | float, reverse: bool = False) -> Column:
    """Index from 0 of the first (or last) equal value; missing if there is none."""
    hits = [F.when(c == value, F.lit(i)) for i, c in enumerate(cols)]
    return F.coalesce(*(hits[::-1] if reverse else hits)).cast("smallint")


def array_modify(cols: list[Column], values: list[Column], index: int, length: int = 0) -> list[Column]:
    """values in place of length elements from index on; with length 0 they are inserted."""
    if not 0 <= index <= len(cols):
        raise IndexError(f"index {index} is out of range")
    return [*cols[:index], *values, *cols[index + length :]]


def array_interpolate_linear(cols: list[Column]) -> list[Column]:
    """Interior gaps filled by the distance of indices; the ends stay missing."""
    out = []
    for i, c in enumerate(cols):
        left = [(i - j, cols[j]) for j in range(i - 1, -1, -1)]
        right = [(j - i, cols[j]) for j in range(i + 1, len(cols))]
        if not left or not right:
            out.append(c)
            continue
        near = [F.coalesce(*(v for _, v in side)) for side in (left, right)]
        gap = [F.coalesce(*(F.when(v.isNotNull(), F.lit(float(d))) for d, v in side)) for side in (left, right)]
        out.append(F.coalesce(c, near[0] + (near[1] - near[0]) * gap[0] / (gap[0] + gap[1])))
    return out
