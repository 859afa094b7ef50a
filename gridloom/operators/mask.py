"""Masks and filters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.cube import RasterCube


def _masked(band: Column, mask: Column, replacement: float | None, there: Column) -> Column:
    """Where a mask cell is there and isn't zero (a missing one counts), data become the replacement."""
    hit = there & (mask.isNull() | (mask != 0)) & band.isNotNull()
    return F.when(hit, F.lit(replacement)).otherwise(band)


def raster_mask(cube: RasterCube, mask: RasterCube, replacement: float | None = None) -> RasterCube:
    """Mask of the same kind: cells without a mask cell stay. A mask without time over a cube with time: they go.

    One mask band holds for all bands, else bands go in pairs.
    """
    if len(mask.bands) not in (1, len(cube.bands)):
        raise ValueError(f"{len(mask.bands)} mask bands for {len(cube.bands)} bands")
    keys = mask.keys
    side = mask.df.select(*keys, *(F.col(b).alias(f"__m{i}") for i, b in enumerate(mask.bands)), F.lit(True).alias("__there"))
    joined = cube.df.join(side, keys, "left" if cube.meta.has_time == mask.meta.has_time else "inner")
    there = F.col("__there").isNotNull()
    return cube.on(joined.select(*cube.keys, *(_masked(F.col(b), F.col(f"__m{i if len(mask.bands) > 1 else 0}"), replacement, there).alias(b) for i, b in enumerate(cube.bands))))


def data_mask(cube: RasterCube, mask: RasterCube, pixelwise: bool = False) -> RasterCube:
    """Only tiles in which the mask has a valid (zero) cell are kept; pixelwise, masked cells become missing, too."""
    tx, ty = mask.meta.tile_of()
    time = ["t"] if mask.meta.has_time else []
    valid = mask.df.filter(F.col(mask.bands[0]) == 0).select(tx.alias("__tx"), ty.alias("__ty"), *time).distinct()
    cx, cy = cube.meta.tile_of()
    kept = cube.on(cube.df.withColumns({"__tx": cx, "__ty": cy}).join(valid, ["__tx", "__ty", *time], "left_semi"))
    return raster_mask(kept, mask) if pixelwise else kept


def filter_bbox(cube: RasterCube, xmin: float, ymin: float, xmax: float, ymax: float) -> RasterCube:
    """Cells whose centres lie in the box, lower and right edges excluded; a filter on the key columns reaches the scan."""
    m = cube.meta
    first_x, last_x = (math.ceil((edge - m.xmin) / m.cell_w - 0.5) for edge in (xmin, xmax))
    first_y, last_y = (math.floor((m.ymax - edge) / m.cell_h - 0.5) for edge in (ymax, ymin))
    return cube.on(cube.df.filter(F.col("x").between(first_x, last_x - 1) & F.col("y").between(first_y + 1, last_y)))


def filter_tiles(cube: RasterCube, col_min: int, row_min: int, col_max: int, row_max: int) -> RasterCube:
    """Whole tiles in a range of tile keys."""
    m = cube.meta
    x, y = F.col("x"), F.col("y")
    return cube.on(cube.df.filter((x >= col_min * m.tile_cols) & (x < (col_max + 1) * m.tile_cols) & (y >= row_min * m.tile_rows) & (y < (row_max + 1) * m.tile_rows)))


def filter_temporal(cube: RasterCube, start, end) -> RasterCube:
    """Dates from start up to but without end."""
    return cube.on(cube.df.filter((F.col("t") >= F.lit(start).cast("date")) & (F.col("t") < F.lit(end).cast("date"))))


def filter_by_times(cube: RasterCube, spans: list[tuple]) -> RasterCube:
    """Dates in any of the closed spans; a span of one date is that date."""
    tests = [F.col("t").between(F.lit(s[0]).cast("date"), F.lit(s[-1]).cast("date")) for s in spans]
    return cube.on(cube.df.filter(reduce(lambda a, b: a | b, tests)))


def filter_labels(cube: RasterCube, condition) -> RasterCube:
    """Dates for which condition(t) holds."""
    return cube.on(cube.df.filter(condition(F.col("t"))))


def filter_bands(cube: RasterCube, bands: list[str | int]) -> RasterCube:
    names = tuple(cube.band(b) for b in bands)
    return cube.on(cube.df, bands=names, types=())


def filter_empty(cube: RasterCube) -> RasterCube:
    """Cells with any data."""
    return cube.on(cube.df.filter(F.coalesce(*(F.col(b).cast("double") for b in cube.bands)).isNotNull()))


def filter_negative_tiles(cube: RasterCube) -> RasterCube:
    tx, ty = cube.meta.tile_of()
    return cube.on(cube.df.filter((tx >= 0) & (ty >= 0)))


def at_instant(cube: RasterCube, instant=None) -> RasterCube:
    """The cube without time: all dates' cells, or those of one date."""
    df = cube.df if instant is None else cube.df.filter(F.col("t") == F.lit(instant).cast("date"))
    return cube.on(df.drop("t"), has_time=False)


def lookup(cube: RasterCube, col: int, row: int):
    """Rows of one tile."""
    return filter_tiles(cube, col, row, col, row).df


def tile_keys(cube: RasterCube):
    tx, ty = cube.meta.tile_of()
    return cube.df.select(tx.alias("tcol"), ty.alias("trow"), *(["t"] if cube.meta.has_time else [])).distinct()
