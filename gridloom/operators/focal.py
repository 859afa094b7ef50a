"""Neighbourhood operators.

Small neighbourhoods: each cell is sent to the cells whose neighbourhood holds it (an explode over a listed table of
offsets, before any shuffle), and one aggregation by cell follows; no join. Large kernels: tiles with halos and a Fourier
transform in numpy. Neighbours that are missing or lie beyond the edge count nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.operators.grid import retile
from gridloom.ship import ship

#: Kernels of more cells on an edge go through the Fourier transform.
DIRECT = 10

Offsets = list[tuple[int, int, float]]


def square(extent: int) -> Offsets:
    return [(dx, dy, 1.0) for dy in range(-extent, extent + 1) for dx in range(-extent, extent + 1)]


def circle(radius: float) -> Offsets:
    return [o for o in square(math.floor(radius)) if math.hypot(o[0], o[1]) <= radius]


def nesw(extent: int) -> Offsets:
    return [o for o in square(extent) if 0 in o[:2]]


def annulus(inner: float, outer: float) -> Offsets:
    return [o for o in square(math.floor(outer)) if inner <= math.hypot(o[0], o[1]) <= outer]


def wedge(radius: float, start: float, end: float) -> Offsets:
    """Angles in degrees, counterclockwise from east; the centre belongs to it."""
    def inside(dx: int, dy: int) -> bool:
        angle = math.degrees(math.atan2(-dy, dx)) % 360
        return (dx, dy) == (0, 0) or (start % 360 <= angle <= end % 360 if start % 360 <= end % 360 else angle >= start % 360 or angle <= end % 360)

    return [o for o in circle(radius) if inside(o[0], o[1])]


def kernel_offsets(kernel: list[list[float]]) -> Offsets:
    rows, cols = len(kernel), len(kernel[0])
    return [(j - cols // 2, i - rows // 2, float(w)) for i, row in enumerate(kernel) for j, w in enumerate(row) if w]


def neighbours(cube: RasterCube, offsets: Offsets):
    """Each cell at the places x, y whose neighbourhood holds it, as dx, dy (seen from there), w and its bands.

    Only places that are cells of the cube get a result: __own marks the cell itself.
    """
    table = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in offsets if (dx, dy) != (0, 0)))
    own = [w for dx, dy, w in offsets if (dx, dy) == (0, 0)]
    centre = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(own[0] if own else None).cast("double").alias("w")))
    time = ["t"] if cube.meta.has_time else []
    df = cube.df.select("x", "y", *time, *cube.bands, F.inline(F.concat(centre, table) if len(offsets) > len(own) else centre))
    moved = df.select((F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y"), *time, "dx", "dy", "w", *cube.bands)
    return moved.withColumn("__own", (F.col("dx") == 0) & (F.col("dy") == 0))


def _gather(cube: RasterCube, offsets: Offsets, made: dict[str, Column], extra: dict | None = None) -> RasterCube:
    rows = neighbours(cube, offsets).groupBy(*cube.keys).agg(F.bool_or("__own").alias("__own"), *(c.alias(n) for n, c in made.items()))
    out = rows.filter("__own").drop("__own")
    return cube.on(out.select(*cube.keys, *(extra or {n: F.col(n) for n in made}).values()) if extra else out, bands=tuple(extra or made), types=())


FOCAL = {
    "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sd": F.stddev_pop,
    "mode": lambda v: F.mode(v, deterministic=True),
}


def focal(cube: RasterCube, op: str, offsets: Offsets, bands: list[str] | None = None) -> RasterCube:
    """An aggregate of each neighbourhood, for all or some bands."""
    used = F.col("w").isNotNull()
    return _gather(cube, offsets, {b: FOCAL[op](F.when(used, F.col(b))).alias(b) for b in bands or cube.bands})


def conway(cube: RasterCube) -> RasterCube:
    """A cell lives (1) with three living neighbours, or with two if it lives; else it is 0."""
    out = {}
    for b in cube.bands:
        around = F.sum(F.when(~F.col("__own"), (F.col(b) > 0).cast("int")))
        lives = F.max(F.when(F.col("__own"), (F.col(b) > 0).cast("int")))
        out[b] = F.when((around == 3) | ((around == 2) & (lives == 1)), 1).otherwise(0)
    return _gather(cube, square(1), out)


def apply_kernel(cube: RasterCube, kernel: list[list[float]]) -> RasterCube:
    """Sum of products with the kernel turned as it is written; beyond DIRECT cells by Fourier transform."""
    if max(len(kernel), len(kernel[0])) > DIRECT:
        return convolve_fft(cube, kernel)
    return _gather(cube, kernel_offsets(kernel), {b: F.sum(F.col(b) * F.col("w")) for b in cube.bands})


def correlate(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size sums of products by Fourier transform; missing values count nothing."""
    rows, cols = values.shape[0] + kernel.shape[0] - 1, values.shape[1] + kernel.shape[1] - 1
    flipped = kernel[::-1, ::-1]
    full = np.fft.irfft2(np.fft.rfft2(np.nan_to_num(values), (rows, cols)) * np.fft.rfft2(flipped, (rows, cols)), (rows, cols))
    top, left = kernel.shape[0] - 1 - kernel.shape[0] // 2, kernel.shape[1] - 1 - kernel.shape[1] // 2
    return full[top : top + values.shape[0], left : left + values.shape[1]]


def on_tiles(cube: RasterCube, function, halo: int, tile: int = 256, bands: tuple[str, ...] | None = None) -> RasterCube:
    """function({band: array with NaN for missing cells}) -> {band: array} for each tile with a halo, in numpy.

    A task holds one tile at a time. Cells that aren't in the cube aren't in the result.
    """
    ship(cube.df.sparkSession)
    names, out = cube.bands, bands or cube.bands
    time = ["t"] if cube.meta.has_time else []
    size = tile + 2 * halo
    tiled = retile(cube, tile, tile, halo, halo).select("tcol", "trow", *time, "ix", "iy", "x", "y", *(F.col(b).cast("double").alias(b) for b in names))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        iy, ix = rows["iy"].to_numpy(), rows["ix"].to_numpy()
        arrays = {}
        for b in names:
            arrays[b] = np.full((size, size), np.nan)
            arrays[b][iy, ix] = rows[b].to_numpy(dtype=float)
        made = function(arrays)
        inner = ((ix >= halo) & (ix < halo + tile) & (iy >= halo) & (iy < halo + tile)).nonzero()[0]
        kept = rows.iloc[inner][["x", "y", *time]].copy()
        for b in out:
            kept[b] = np.asarray(made[b], dtype=float)[iy[inner], ix[inner]]  # NaN becomes NULL
        return kept

    kinds = dict(cube.df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in ["x", "y", *time]] + [f"`{b}` double" for b in out])
    return cube.on(tiled.groupBy("tcol", "trow", *time).applyInPandas(run, schema), bands=tuple(out), types=())


def convolve_fft(cube: RasterCube, kernel: list[list[float]], tile: int = 256) -> RasterCube:
    k = np.array(kernel, dtype=float)
    return on_tiles(cube, lambda arrays: {b: correlate(a, k) for b, a in arrays.items()}, max(k.shape) // 2, tile)


def _gradients(cube: RasterCube, band: str, z_factor: Column | float) -> tuple[dict[str, Column], Column, Column]:
    """The 3 by 3 values around a cell, as aggregates, and the gradients to east and north after Horn."""
    at = {}
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            at[f"v{dy + 1}{dx + 1}"] = F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(band)))

    def v(name: str) -> Column:
        return F.coalesce(F.col(name), F.col("v11"))

    # The factor comes after the differences: rounded before, sides that are equal would leave a slope.
    east = ((v("v02") + 2 * v("v12") + v("v22")) - (v("v00") + 2 * v("v10") + v("v20"))) * z_factor / (8 * cube.meta.cell_w)
    south = ((v("v20") + 2 * v("v21") + v("v22")) - (v("v00") + 2 * v("v01") + v("v02"))) * z_factor / (8 * cube.meta.cell_h)
    return at, east, south


METRES_PER_DEGREE = 111320.0


def z_factor_by_latitude(cube: RasterCube, table: dict[float, float] | None = None) -> Column:
    """Metres to degrees at a cell's latitude: 1 / (metres of a degree), or linear between the table's latitudes."""
    lat = F.abs(cube.meta.centre()[1])
    if table is None:
        return 1 / (F.cos(F.radians(lat)) * METRES_PER_DEGREE)
    points = sorted(table.items())
    out = F.lit(points[-1][1])
    for (a, va), (b, vb) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(lat <= b, va + (lat - a) * ((vb - va) / (b - a))).otherwise(out)
    return F.when(lat <= points[0][0], F.lit(points[0][1])).otherwise(out)


def slope(cube: RasterCube, band: int | str = 0, z_factor: Column | float = 1.0) -> RasterCube:
    """Degrees; missing neighbours take the cell's own value."""
    b = cube.band(band)
    at, east, south = _gradients(cube, b, z_factor)
    steep = F.degrees(F.atan(F.sqrt(east * east + south * south)))
    return _gather(cube, square(1), at, {"slope": F.when(F.col("v11").isNotNull(), steep).alias("slope")})


def aspect(cube: RasterCube, band: int | str = 0, z_factor: Column | float = 1.0) -> RasterCube:
    """Degrees clockwise from north in which the surface falls; missing on the flat."""
    b = cube.band(band)
    at, east, south = _gradients(cube, b, z_factor)
    turned = F.pmod(F.degrees(F.atan2(-east, south)), F.lit(360.0))
    return _gather(cube, square(1), at, {"aspect": F.when(F.col("v11").isNotNull() & ((east != 0) | (south != 0)), turned).alias("aspect")})


def hillshade(cube: RasterCube, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, band: int | str = 0) -> RasterCube:
    """Light from azimuth and altitude on a surface, 0 to 127 (int16)."""
    b = cube.band(band)
    at, east, south = _gradients(cube, b, z_factor)
    steep = F.atan(F.sqrt(east * east + south * south))
    falls = F.atan2(-east, south)
    zenith = math.radians(90 - altitude)
    light = math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(math.radians(azimuth) - falls)
    shade = F.rint(127 * F.greatest(F.lit(0.0), light)).cast("smallint")
    return _gather(cube, square(1), at, {"shade": F.when(F.col("v11").isNotNull(), shade).alias("shade")})


def tobler(cube: RasterCube, band: int | str = 0) -> RasterCube:
    """Walking speed (km/h) on a slope in degrees."""
    b = cube.band(band)
    return cube.with_bands({b: 6 * F.exp(-3.5 * F.abs(F.tan(F.radians(F.col(b))) + 0.05))})


def dilation_mask(cube: RasterCube, erosion: int = 0, mask1: tuple[int, ...] = (2, 4, 5, 6, 7), mask2: tuple[int, ...] = (3, 8, 9, 10, 11), kernel1: int = 17, kernel2: int = 201, tile: int = 256) -> RasterCube:
    """1 where a scene classification (first band) is near cells that are not in mask1, or, by a wider kernel, in mask2.

    Both binary masks are eroded by a disc of `erosion` cells, blurred by Gaussians of kernel1 and kernel2 cells (sigma a
    sixth of the size), and cut at 0.057 and 0.025.
    """
    def gaussian(n: int) -> np.ndarray:
        at = np.arange(n) - n // 2
        k = np.exp(-(at[:, None] ** 2 + at[None, :] ** 2) / (2 * (n / 6.0) ** 2))
        k = np.floor(k * 10000.0)
        return k / k.sum()

    def eroded(mask: np.ndarray) -> np.ndarray:
        if erosion <= 0:
            return mask
        at = np.arange(erosion) - erosion // 2
        disc = (np.hypot(at[:, None], at[None, :]) <= erosion // 2).astype(float)
        return (correlate(1 - mask, disc) <= 0.5).astype(float)

    def near(mask: np.ndarray, n: int, cut: float) -> np.ndarray:
        return (correlate(eroded(mask), gaussian(n)) > cut).astype(float) if n > 0 and mask.any() else mask

    band = cube.bands[0]

    def run(arrays):
        values = arrays[band]
        there = ~np.isnan(values)
        first = near(np.where(there, ~np.isin(values, mask1), 0).astype(float), kernel1, 0.057)
        second = near(np.where(there, np.isin(values, mask2), 0).astype(float), kernel2, 0.025)
        return {"mask": np.maximum(first, second)}

    return on_tiles(cube, run, max(kernel1, kernel2) // 2 + erosion, tile, ("mask",))


def sharpen(cube: RasterCube, fine: list[str], coarse: list[str], size: int = 5, scale: float = 10000.0) -> RasterCube:
    """Coarse bands predicted at the resolution of the fine ones from spectrally near neighbours.

    In a disc of size cells, neighbours are classed by the mean absolute difference of the fine bands (0.0025, 0.005,
    0.01, 0.02, 0.025). The lowest class with at least MIN_NEAR neighbours is used, else the highest; weights are
    1 / (1 + exp(25 * scaled difference - 7.5)); coarse values are their weighted mean.
    """
    reach = (size - 1) // 2
    disc = circle(reach)
    time = ["t"] if cube.meta.has_time else []
    packed = F.struct(*(F.col(b).cast("double").alias(b) for b in cube.bands), "__own")
    rows = neighbours(cube, disc).groupBy("x", "y", *time).agg(F.collect_list(packed).alias("near"))  # at most the disc's cells
    centre = F.try_element_at(F.filter("near", lambda n: n["__own"]), F.lit(1))
    rows = rows.withColumn("centre", centre).filter(F.col("centre").isNotNull())

    def difference(n: Column) -> Column:
        return sum((F.abs(F.col("centre")[b] - n[b]) for b in fine[1:]), F.abs(F.col("centre")[fine[0]] - n[fine[0]])) / (len(fine) * scale)

    rows = rows.withColumn("near", F.transform(F.filter("near", lambda n: n[fine[0]].isNotNull()), lambda n: F.struct(difference(n).alias("d"), *(n[b].alias(b) for b in coarse))))
    def nearer(limit: float) -> Column:
        return F.filter("near", lambda n: n["d"] < limit)

    choices = [nearer(c) for c in SPECTRAL_CLASSES]
    chosen = F.coalesce(*(F.when(F.size(c) >= MIN_NEAR, c) for c in choices), choices[-1])
    rows = rows.withColumn("used", chosen)
    low = F.array_min(F.transform(F.filter("used", lambda n: n["d"] > 0), lambda n: n["d"]))
    high = F.array_max(F.transform("used", lambda n: n["d"]))
    rows = rows.withColumns({"low": low, "high": high})

    def weight(n: Column) -> Column:
        scaled = (n["d"] - F.col("low")) / (F.col("high") - F.col("low"))
        return F.when((n["d"] == 0) | F.col("low").isNull() | (F.col("low") == F.col("high")), F.lit(1.0)).otherwise(1 / (1 + F.exp(25 * scaled - 7.5)))

    def predicted(b: str) -> Column:
        kept = F.filter("used", lambda n: n[b].isNotNull())
        top = F.aggregate(kept, F.lit(0.0), lambda a, n: a + weight(n) * n[b])
        return top / F.nullif(F.aggregate(kept, F.lit(0.0), lambda a, n: a + weight(n)), F.lit(0.0))

    made = {b: F.when(F.col("centre")[fine[0]].isNotNull(), predicted(b)).alias(b) for b in coarse}
    return cube.on(rows.select("x", "y", *time, *made.values()), bands=tuple(coarse), types=())


#: Classes of spectral difference; neighbours that a class needs.
SPECTRAL_CLASSES = (0.0025, 0.005, 0.01, 0.02, 0.025)
MIN_NEAR = 5
