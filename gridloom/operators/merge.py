"""merge_cubes, layer unions and arithmetic between layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.functions import scalar

#: Cubes without time up to this number of cells (about 100 bytes each) are broadcast to one with time.
BROADCAST_CELLS = 500_000


def _bool(a: Column, b: Column, op) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), op(a, b))


OVERLAP = {
    "or": lambda a, b: _bool(a, b, lambda x, y: x.cast("long").bitwiseOR(y.cast("long"))),
    "and": lambda a, b: _bool(a, b, lambda x, y: x.cast("long").bitwiseAND(y.cast("long"))),
    "xor": lambda a, b: _bool(a, b, lambda x, y: x.cast("long").bitwiseXOR(y.cast("long"))),
    "divide": scalar.divide,
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "multiply": lambda a, b: a * b,
    "product": lambda a, b: a * b,
    "add": lambda a, b: a + b,
    "sum": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
}


def _check(left: RasterCube, right: RasterCube, operator: str | None) -> None:
    if operator is not None and operator not in OVERLAP:
        raise NotImplementedError(f"unsupported operator {operator}")
    if operator is not None and left.bands and right.bands and len(left.bands) != len(right.bands):
        raise ValueError(f"an operator needs equal numbers of bands: {left.bands} and {right.bands}")
    if not left.meta.same_grid(right.meta):
        raise ValueError("the cubes lie on different grids; resample one of them first")


def _merged(joined, left: RasterCube, right: RasterCube, operator: str | None, keys: list[str], one_side: bool, swap: bool = False):
    """Bands of two joined sides, left as l_<i>, right as r_<i>."""
    if operator is None or not left.bands or not right.bands:
        names = _distinct(left.bands, right.bands)
        cols = [F.col(f"l_{i}").alias(n) for i, n in enumerate(names[: len(left.bands)])] + [F.col(f"r_{i}").alias(n) for i, n in enumerate(names[len(left.bands) :])]
        return joined.select(*keys, *cols), tuple(names)
    op = OVERLAP[operator]

    def cell(i: int) -> Column:
        a, b = F.col(f"l_{i}"), F.col(f"r_{i}")
        both = op(b, a) if swap else op(a, b)
        # A key of one side only keeps its cells as they are.
        return F.when(F.col("__l").isNull(), b).when(F.col("__r").isNull(), a).otherwise(both) if one_side else both

    return joined.select(*keys, *(cell(i).alias(n) for i, n in enumerate(left.bands))), left.bands


def _distinct(left: tuple[str, ...], right: tuple[str, ...]) -> list[str]:
    names = list(left)
    for b in right:
        n = b
        while n in names:
            n += "_2"
        names.append(n)
    return names


def _side(cube: RasterCube, mark: str):
    return cube.df.select(*cube.keys, *(F.col(b).alias(f"{mark}_{i}") for i, b in enumerate(cube.bands)), F.lit(True).alias(f"__{mark}"))


def merge_cubes(left: RasterCube, right: RasterCube, operator: str | None = None, spatial_cells: int | None = None) -> RasterCube:
    """Both with time or both without: full outer join on the cells; without operator bands are put side by side.

    One with and one without time: each of the first's dates meets the second's cells, other cells go. The side without
    time is broadcast only if spatial_cells, its known number of cells, is at most BROADCAST_CELLS.
    """
    _check(left, right, operator)
    if left.meta.has_time == right.meta.has_time:
        joined = _side(left, "l").join(_side(right, "r"), left.keys, "full_outer")
        df, names = _merged(joined, left, right, operator, left.keys, one_side=True)
        return left.on(df, bands=names, types=())
    timed, flat, swap = (left, right, False) if left.meta.has_time else (right, left, True)
    other = _side(flat, "r")
    other = F.broadcast(other) if spatial_cells is not None and spatial_cells <= BROADCAST_CELLS else other
    joined = _side(timed, "l").join(other, ["x", "y"])
    df, names = _merged(joined, timed, flat, operator, timed.keys, one_side=False, swap=swap)
    return timed.on(df, bands=names, types=())


def union_layers(cubes: list[RasterCube]) -> RasterCube:
    """All rows of cubes of one kind."""
    if len({(c.bands, c.meta.has_time) for c in cubes}) != 1:
        raise ValueError("layers of one kind only can be put together")
    return cubes[0].on(reduce(lambda a, b: a.unionByName(b), (c.df for c in cubes)))


def difference(cube: RasterCube, other: RasterCube) -> RasterCube:
    """Rows of the cube whose cells the other doesn't have."""
    return cube.on(cube.df.join(other.df.select(*cube.keys), cube.keys, "left_anti"))


def absolute(cube: RasterCube) -> RasterCube:
    return cube.with_bands({b: F.abs(F.col(b)) for b in cube.bands})


def combine_bands(cubes: list[RasterCube]) -> RasterCube:
    """Bands of all cubes side by side, in the order of the cubes: one aggregation over their union."""
    names = [f"{b}_{i}" for i, c in enumerate(cubes) for b in c.bands]
    rows = []
    for i, c in enumerate(cubes):
        own = {f"{b}_{i}": F.col(b).cast("double") for b in c.bands}
        rows.append(c.df.select(*c.keys, *(own.get(n, F.lit(None).cast("double")).alias(n) for n in names)))
    df = reduce(lambda a, b: a.unionByName(b), rows).groupBy(*cubes[0].keys).agg(*(F.max(n).alias(n) for n in names))
    return cubes[0].on(df, bands=tuple(names), types=())


def merge_tiles(cubes: list[RasterCube]) -> RasterCube:
    """One row for each cell; of several layers the first with data wins, band by band."""
    rows = [c.df.withColumn("__n", F.lit(i)) for i, c in enumerate(cubes)]
    df = reduce(lambda a, b: a.unionByName(b), rows)
    picked = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("__n"))).alias(b) for b in cubes[0].bands]
    return cubes[0].on(df.groupBy(*cubes[0].keys).agg(*picked))


LOCAL = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": scalar.divide,
    "pow": scalar.power, "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
}


def local(cube: RasterCube, op: str, other: RasterCube | float, reverse: bool = False) -> RasterCube:
    """Arithmetic with a number or, cell by cell and band by band, with another layer (cells of both only)."""
    f = LOCAL[op]
    if not isinstance(other, RasterCube):
        return cube.with_bands({b: f(F.lit(other), F.col(b)) if reverse else f(F.col(b), F.lit(other)) for b in cube.bands})
    _check(cube, other, "add")
    joined = _side(cube, "l").join(_side(other, "r"), cube.keys)
    pairs = [(F.col(f"l_{i}"), F.col(f"r_{i}")) for i in range(len(cube.bands))]
    return cube.on(joined.select(*cube.keys, *((f(b, a) if reverse else f(a, b)).alias(n) for n, (a, b) in zip(cube.bands, pairs, strict=True))), types=())
