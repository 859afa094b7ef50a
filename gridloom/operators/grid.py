"""Grids: resampling, tiles, pyramids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.meta import CubeMeta

EARTH = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * (math.pi / 180 * EARTH), F.ln(F.tan(math.pi / 4 + lat * (math.pi / 360))) * EARTH


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x / (math.pi / 180 * EARTH), (F.atan(F.exp(y / EARTH)) * 2 - math.pi / 2) * (180 / math.pi)


#: The ellipsoid WGS 84, the scale of UTM on its central meridians.
WGS84_A, WGS84_F, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = WGS84_F / (2 - WGS84_F)
_RADIUS = UTM_SCALE * WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the transverse Mercator series of Krueger to the fourth power of the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def to_utm(lon: Column, lat: Column, zone: Column, is_north: Column) -> tuple[Column, Column]:
    """Easting and northing of degrees in a UTM zone (1 to 60)."""
    turn = F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + _RADIUS * x, F.when(is_north, F.lit(0.0)).otherwise(F.lit(1e7)) + _RADIUS * y


def from_utm(east: Column, north: Column, zone: Column, is_north: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a UTM coordinate."""
    eta = (east - 500000.0) / _RADIUS
    xi = (north - F.when(is_north, F.lit(0.0)).otherwise(F.lit(1e7))) / _RADIUS
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(lat)


def _utm_zone(crs: str) -> tuple[Column, Column] | None:
    """Zone and hemisphere of EPSG:326zz and EPSG:327zz."""
    code = crs.removeprefix("EPSG:")
    if len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return F.lit(int(code[3:])), F.lit(code[:3] == "326")
    return None


def transform(cx: Column, cy: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates between EPSG:4326, EPSG:3857 and UTM zones (EPSG:326zz, EPSG:327zz), as expressions."""
    if source == target:
        return cx, cy
    if source == "EPSG:3857":
        lon, lat = from_mercator(cx, cy)
    elif zone := _utm_zone(source):
        lon, lat = from_utm(cx, cy, *zone)
    elif source == "EPSG:4326":
        lon, lat = cx, cy
    else:
        raise NotImplementedError(f"no transform from {source}")
    if target == "EPSG:4326":
        return lon, lat
    if target == "EPSG:3857":
        return to_mercator(lon, lat)
    if zone := _utm_zone(target):
        return to_utm(lon, lat, *zone)
    raise NotImplementedError(f"no transform to {target}")


def _separable(a: str, b: str) -> bool:
    """Whether columns of one system follow columns of the other alone, and rows rows."""
    return a == b or {a, b} == {"EPSG:4326", "EPSG:3857"}


def _grid(meta: CubeMeta, target: CubeMeta) -> CubeMeta:
    return meta.of(xmin=target.xmin, ymax=target.ymax, cell_w=target.cell_w, cell_h=target.cell_h, crs=target.crs)


def _places(cube: RasterCube, meta: CubeMeta, cols: int, rows: int):
    """(__x, __y, __gx, __gy): target cells and the place of their centres in cells of the source, for systems that aren't separable."""
    m, spark = cube.meta, cube.df.sparkSession
    cells = spark.range(cols * rows).select((F.col("id") % cols).alias("x"), F.expr(f"id div {cols}").alias("y"))
    cx, cy = transform(*meta.centre(), meta.crs, m.crs)
    return cells.select(F.col("x").alias("__x"), F.col("y").alias("__y"), ((cx - m.xmin) / m.cell_w).alias("__gx"), ((m.ymax - cy) / m.cell_h).alias("__gy"))


def resample_nearest(cube: RasterCube, target: CubeMeta, cols: int, rows: int) -> RasterCube:
    """Target cells 0..cols-1 by 0..rows-1 take the source cell that holds their centre; no-op on an equal grid.

    Where both systems are separable, source columns and rows depend on x and y alone: two listed maps (cols and rows
    long) join the cells, so enlarging needs no grid of all cells and shrinking drops cells early. Else a distributed
    table of the target's cells meets the source by cell.
    """
    if cube.meta.same_grid(target):
        return cube
    spark = cube.df.sparkSession
    meta = _grid(cube.meta, target)
    if not _separable(cube.meta.crs, target.crs):
        at = _places(cube, meta, cols, rows).select("__x", "__y", F.floor("__gx").cast("long").alias("x"), F.floor("__gy").cast("long").alias("y"))
        return RasterCube(cube.df.join(at, ["x", "y"]).drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"}), meta)
    tx, ty = meta.centre()
    xs = spark.range(cols).select(F.col("id").alias("x"), F.lit(0).alias("y"))
    ys = spark.range(rows).select(F.lit(0).alias("x"), F.col("id").alias("y"))
    sx = cube.meta.cell_of(*transform(tx, ty, target.crs, cube.meta.crs))
    xs = xs.select(F.col("x").alias("__x"), sx[0].alias("x"))
    ys = ys.select(F.col("y").alias("__y"), sx[1].alias("y"))
    out = cube.df.join(xs, "x").join(ys, "y").drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"})
    return RasterCube(out, meta)


def _triangle(d: Column) -> Column:
    return 1 - d


def _cubic(d: Column) -> Column:
    """Keys' kernel with a = -1/2."""
    return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).otherwise(((-0.5 * d + 2.5) * d - 4) * d + 2)


def _spline(d: Column) -> Column:
    """The cubic B-spline."""
    return F.when(d <= 1, (4 - 6 * d * d + 3 * d * d * d) / 6).otherwise((2 - d) * (2 - d) * (2 - d) / 6)


def _lanczos(d: Column) -> Column:
    return F.when(d == 0, F.lit(1.0)).otherwise(3 * F.sin(math.pi * d) * F.sin(math.pi * d / 3) / (math.pi * math.pi * d * d))


#: Interpolation kernels: reach in cells, weight by distance.
KERNELS = {"bilinear": (1, _triangle), "cubic": (2, _cubic), "cubicspline": (2, _spline), "lanczos": (3, _lanczos)}


def interpolate(cube: RasterCube, target: CubeMeta, cols: int, rows: int, method: str = "bilinear") -> RasterCube:
    """As resample_nearest, with the weights of a kernel over the cells around; missing cells and those beyond the edge count nothing."""
    if cube.meta.same_grid(target):
        return cube
    spark, m, meta = cube.df.sparkSession, cube.meta, _grid(cube.meta, target)
    reach, kernel = KERNELS[method]

    def around(position: Column, name: str) -> Column:
        """The cells within reach of a place (in cells, from cell centres) on one axis, with weights."""
        low = F.floor(position)
        return F.array(*(F.struct((low + i).cast("long").alias(name), kernel(F.abs(position - low - i)).alias(f"__w{name}")) for i in range(1 - reach, reach + 1)))

    if _separable(m.crs, target.crs):
        def axis(n: int, cell: str, at: Column):
            return spark.range(n).select(F.col("id").alias(f"__{cell}"), F.inline(around(at - 0.5, cell))).filter(F.col(f"__w{cell}") != 0)

        half = F.col("id") + 0.5
        sx, sy = transform(meta.xmin + half * meta.cell_w, meta.ymax - half * meta.cell_h, target.crs, m.crs)
        placed = cube.df.join(axis(cols, "x", (sx - m.xmin) / m.cell_w), "x").join(axis(rows, "y", (m.ymax - sy) / m.cell_h), "y")
    else:
        at = _places(cube, meta, cols, rows).select("__x", "__y", "__gy", F.inline(around(F.col("__gx") - 0.5, "x")))
        at = at.select("__x", "__y", "x", "__wx", F.inline(around(F.col("__gy") - 0.5, "y")))
        placed = cube.df.join(at, ["x", "y"])
    weight = F.col("__wx") * F.col("__wy")
    out = placed.groupBy(F.col("__x").alias("x"), F.col("__y").alias("y"), *(["t"] if m.has_time else []))
    out = out.agg(*((F.sum(F.col(b) * weight) / F.nullif(F.sum(F.when(F.col(b).isNotNull(), weight)), F.lit(0.0))).alias(b) for b in cube.bands))
    return RasterCube(out, meta)


def resample_bilinear(cube: RasterCube, target: CubeMeta, cols: int, rows: int) -> RasterCube:
    return interpolate(cube, target, cols, rows, "bilinear")


#: Resampling methods that gather the source cells whose centres lie in a target cell.
GATHERED = {
    "average": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "med": F.median, "mode": lambda v: F.mode(v, deterministic=True),
    "q1": lambda v: F.percentile(v, 0.25), "q3": lambda v: F.percentile(v, 0.75), "rms": lambda v: F.sqrt(F.avg(v * v)),
}


def gather(cube: RasterCube, target: CubeMeta, cols: int, rows: int, method: str = "average") -> RasterCube:
    """Target cells from all source cells whose centres they hold; cells without any are absent. One aggregation, no join."""
    meta = _grid(cube.meta, target)
    tx, ty = meta.cell_of(*transform(*cube.meta.centre(), cube.meta.crs, target.crs))
    placed = cube.df.withColumns({"__x": tx, "__y": ty}).filter(F.col("__x").between(0, cols - 1) & F.col("__y").between(0, rows - 1))
    out = placed.groupBy(F.col("__x").alias("x"), F.col("__y").alias("y"), *(["t"] if cube.meta.has_time else []))
    return RasterCube(out.agg(*(GATHERED[method](F.col(b)).alias(b) for b in cube.bands)), meta)


def resample(cube: RasterCube, target: CubeMeta, cols: int, rows: int, method: str = "near") -> RasterCube:
    """Any method: near, the kernels of KERNELS, the aggregates of GATHERED."""
    if method in ("near", "nearest"):
        return resample_nearest(cube, target, cols, rows)
    if method in KERNELS:
        return interpolate(cube, target, cols, rows, method)
    if method in GATHERED:
        return cube if cube.meta.same_grid(target) else gather(cube, target, cols, rows, method)
    raise NotImplementedError(f"unknown resampling method {method}")


def tile_to_layout(tiles, meta: CubeMeta, target: CubeMeta, cols: int, rows: int, method: str = "near") -> RasterCube:
    """Tiles that each have a place of their own (tcol, trow, ix, iy and bands) laid on a target grid.

    Tile keys and places become cells of one grid first; where tiles overlap, the first in the order of keys wins.
    """
    bands = meta.bands
    placed = tiles.select((F.col("tcol") * meta.tile_cols + F.col("ix")).alias("x"), (F.col("trow") * meta.tile_rows + F.col("iy")).alias("y"), *(["t"] if meta.has_time else []), F.struct("trow", "tcol").alias("__k"), *bands)
    picked = placed.groupBy(*meta.keys).agg(*(F.min_by(b, F.when(F.col(b).isNotNull(), F.col("__k"))).alias(b) for b in bands))
    return resample(RasterCube(picked, meta), target, cols, rows, method)


def retile(cube: RasterCube, size_x: int, size_y: int, overlap_x: int = 0, overlap_y: int = 0):
    """Rows with tile keys tcol, trow and the place in the tile (ix, iy); with overlap, cells go to neighbouring tiles, too.

    A cell lies in at most as many tiles as overlaps reach, found from its index alone.
    """
    def tiles(axis: str, size: int, overlap: int) -> Column:
        low = F.floor((F.col(axis) - overlap) / size).cast("long")
        high = F.floor((F.col(axis) + overlap) / size).cast("long")
        return F.sequence(low, high)

    df = cube.df.withColumn("tcol", F.explode(tiles("x", size_x, overlap_x))).withColumn("trow", F.explode(tiles("y", size_y, overlap_y)))
    return df.withColumns({"ix": F.col("x") - F.col("tcol") * size_x + overlap_x, "iy": F.col("y") - F.col("trow") * size_y + overlap_y})


def remove_overlap(tiled, size_x: int, size_y: int, overlap_x: int, overlap_y: int):
    """Rows of retile without the overlap."""
    return tiled.filter(F.col("ix").between(overlap_x, overlap_x + size_x - 1) & F.col("iy").between(overlap_y, overlap_y + size_y - 1))


def regrid(cube: RasterCube, size_x: int, size_y: int) -> RasterCube:
    """Other tile size, the upper left corner stays: cells don't move."""
    return cube.on(cube.df, tile_cols=size_x, tile_rows=size_y)


METHODS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median, "mode": F.mode}


def halve(cube: RasterCube, method: str = "mean") -> RasterCube:
    """One pyramid level up: 2 by 2 cells become one. `nearest` takes the upper left cell."""
    time = ["t"] if cube.meta.has_time else []
    up = [F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), *time]
    changes = {"cell_w": cube.meta.cell_w * 2, "cell_h": cube.meta.cell_h * 2}
    if method == "nearest":
        return cube.on(cube.df.filter((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).select(*up, *cube.bands), **changes)
    return cube.on(cube.df.groupBy(*up).agg(*(METHODS[method](b).alias(b) for b in cube.bands)), **changes)


def pyramid(cube: RasterCube, levels: int, method: str = "mean") -> dict[int, RasterCube]:
    """Cubes by zoom level, the finest at `levels`; a level is made from the one below it."""
    out = {levels: cube}
    for zoom in range(levels - 1, -1, -1):
        out[zoom] = halve(out[zoom + 1], method)
    return out


def power_of_two(cube: RasterCube, cols: int, rows: int) -> RasterCube:
    """Each tile resampled to the next powers of two, by nearest cells: cols by rows is the size of the whole cube."""
    m = cube.meta
    wide, high = 1 << math.ceil(math.log2(m.tile_cols)), 1 << math.ceil(math.log2(m.tile_rows))
    grid = m.of(cell_w=m.cell_w * m.tile_cols / wide, cell_h=m.cell_h * m.tile_rows / high)
    out = resample_nearest(cube, grid, math.ceil(cols / m.tile_cols) * wide, math.ceil(rows / m.tile_rows) * high)
    return out.on(out.df, tile_cols=wide, tile_rows=high)


def summary(cube: RasterCube):
    """One row: cells, extent of indices and of coordinates, dates, tiles."""
    m = cube.meta
    tx, ty = m.tile_of()
    made = [F.count("*").alias("cells"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")]
    made += [F.min(tx).alias("tcol_min"), F.max(tx).alias("tcol_max"), F.min(ty).alias("trow_min"), F.max(ty).alias("trow_max")]
    if m.has_time:
        made += [F.min("t").alias("t_min"), F.max("t").alias("t_max")]
    return cube.df.agg(*made)


def z_order(cube: RasterCube, bits: int = 16) -> Column:
    """Morton number of a cell's tile: its bits interleaved."""
    tx, ty = cube.meta.tile_of()
    out = F.lit(0).cast("long")
    for i in range(bits):
        one = F.lit(1).cast("long")
        out = out.bitwiseOR(F.shiftleft(F.shiftright(tx, i).bitwiseAND(one), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(ty, i).bitwiseAND(one), 2 * i + 1))
    return out


def partition_by_space(cube: RasterCube, partitions: int | None = None) -> RasterCube:
    """Neighbouring tiles in one partition, by ranges of the Morton number; all cells and dates of a tile stay together."""
    df = cube.df.withColumn("__z", z_order(cube))
    return cube.on(df.repartitionByRange(partitions, "__z") if partitions else df.repartitionByRange("__z"))


#: Fixed values of the military grid: column letters by zone in threes, row letters, latitude bands of 8 degrees from 80 S.
COLUMN_LETTERS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"
BAND_LETTERS = "CDEFGHJKLMNPQRSTUVWX"
SQUARE = 100_000


def _letter(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1))


def grid_square(east: Column, north: Column, zone: Column, is_north: Column) -> Column:
    """Zone, latitude band and the two letters of the 100 km square of a UTM coordinate.

    Columns count from the first 100 km of easting, with letters that repeat every three zones; rows repeat every 20
    squares and start five letters later in even zones; the band is that of the coordinate's latitude (80 S to 84 N, the
    last one 12 degrees high). Beyond these the name is missing.
    """
    _, lat = from_utm(east, north, zone, is_north)
    band = F.when((lat >= -80) & (lat <= 84), _letter(BAND_LETTERS, F.least(F.floor((lat + 80) / 8), F.lit(len(BAND_LETTERS) - 1))))
    place = F.floor(east / SQUARE) - 1
    column = F.coalesce(*(F.when((zone - 1) % 3 == i, _letter(letters, place)) for i, letters in enumerate(COLUMN_LETTERS)))
    shift = F.when(zone % 2 == 0, F.lit(5)).otherwise(F.lit(0))
    row = _letter(ROW_LETTERS, F.pmod(F.floor(north / SQUARE) + shift, F.lit(len(ROW_LETTERS))))
    return F.concat(F.lpad(zone.cast("string"), 2, "0"), band, F.when(place.between(0, 7), column), row)


def degree_tile(lon: Column, lat: Column) -> Column:
    """Name of the one-degree tile that holds a coordinate: N51E005."""
    x, y = F.floor(lon).cast("int"), F.floor(lat).cast("int")
    return F.concat(F.when(y < 0, F.lit("S")).otherwise(F.lit("N")), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x < 0, F.lit("W")).otherwise(F.lit("E")), F.lpad(F.abs(x).cast("string"), 3, "0"))
