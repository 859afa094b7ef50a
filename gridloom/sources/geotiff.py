"""GeoTIFF files: a decoder for load_files and an encoder for sinks, in numpy and zlib.

Read: strips and tiles, uncompressed or deflate, with or without the horizontal predictor, bands side by side or in
planes, integers and floats of 8 to 64 bits, pixel scale and tie point, EPSG code, missing-value tag. Written: tiles,
deflate, bands in planes, the same tags.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.meta import CubeMeta
from gridloom.ship import ship
from gridloom.sources.readers import load_files

#: Fixed values of the format: field types (code, bytes), tags.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_AT, TILE_SIZE, FORMAT, SCALE, TIE, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
DEFLATE = (8, 32946)


@dataclass
class Raster:
    """values (bands, rows, cols), NaN where missing; the corner and the size of cells; the EPSG code if it is known."""

    values: np.ndarray
    xmin: float = 0.0
    ymax: float = 0.0
    cell_w: float = 1.0
    cell_h: float = 1.0
    epsg: int | None = None
    nodata: float | None = None
    tags: dict = field(default_factory=dict)


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF of 32-bit offsets")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code, size = TYPES.get(kind, ("B", 1))
        place = at + 10 + 12 * i
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = (data[place : place + count].rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack_from(f"{order}{count}{code}", data, place)
    return order, tags


def read(data: bytes) -> Raster:
    """The first image of a file."""
    order, tags = _tags(data)

    def one(tag: int, default: int) -> int:
        return tags.get(tag, (default,))[0]

    cols, rows, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)] }{one(BITS, 8) // 8}")
    packed, predictor, planes = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and bands > 1
    if packed != 1 and packed not in DEFLATE or predictor not in (1, 2):
        raise ValueError(f"compression {packed} with predictor {predictor} isn't read")
    tiled = TILE_AT in tags
    wide, high = (one(TILE_W, 0), one(TILE_H, 0)) if tiled else (cols, min(one(STRIP_ROWS, rows), rows))
    places, sizes = tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZE if tiled else STRIP_SIZE]
    across, down = -(-cols // wide), -(-rows // high)
    depth = 1 if planes else bands
    out = np.zeros((bands, down * high, across * wide), dtype=kind.newbyteorder("="))
    for i, (at, size) in enumerate(zip(places, sizes, strict=True)):
        plane, cell = divmod(i, across * down)
        top, left = cell // across * high, cell % across * wide
        body = data[at : at + size]
        block = np.frombuffer(zlib.decompress(body) if packed in DEFLATE else body, kind)
        block = block.reshape(-1, wide, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        for d in range(depth):
            out[plane + d if planes else d, top : top + len(block), left : left + wide] = block[:, :, d]
    values = out[:, :rows, :cols].astype(np.float64)
    nodata = float(tags[NODATA][0]) if NODATA in tags and tags[NODATA][0].strip() else None
    if nodata is not None and not np.isnan(nodata):
        values[values == nodata] = np.nan
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    return Raster(values, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], codes.get(3072, codes.get(2048)), nodata, tags)


def write(raster: Raster, tile: int = 256, kind: str = "f4") -> bytes:
    """A tiled, deflated file; missing cells are written as nodata (NaN for floats unless it is given)."""
    bands, rows, cols = raster.values.shape
    dtype = np.dtype("<" + kind)
    nodata = raster.nodata if raster.nodata is not None else np.nan if dtype.kind == "f" else 0
    filled = np.where(np.isnan(raster.values), nodata, raster.values)
    across, down = -(-cols // tile), -(-rows // tile)
    blocks = []
    for b in range(bands):
        for j in range(down):
            for i in range(across):
                block = np.full((tile, tile), nodata, dtype=dtype)
                part = filled[b, j * tile : (j + 1) * tile, i * tile : (i + 1) * tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(zlib.compress(block.tobytes(), 6))
    places = (8 + np.cumsum([0, *map(len, blocks)])).tolist()
    geographic = raster.epsg is not None and 4000 <= raster.epsg < 5000
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, raster.epsg or 32767)
    text = f"{nodata!r}".encode() + b"\0" if not isinstance(nodata, float) or not np.isnan(nodata) else b"nan\0"
    tags = [
        (WIDTH, 4, (cols,)), (HEIGHT, 4, (rows,)), (BITS, 3, (dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (bands,)), (PLANAR, 3, (2,)),
        (TILE_W, 4, (tile,)), (TILE_H, 4, (tile,)), (TILE_AT, 4, tuple(places[:-1])), (TILE_SIZE, 4, tuple(map(len, blocks))), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[dtype.kind],) * bands),
        (SCALE, 12, (raster.cell_w, raster.cell_h, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, raster.xmin, raster.ymax, 0.0)), (GEO_KEYS, 3, keys), (NODATA, 2, text),
    ]
    at = places[-1] + places[-1] % 2
    after = at + 2 + 12 * len(tags) + 4
    entries, tail = b"", b""
    for tag, code, values in tags:
        body = values if code == 2 else struct.pack(f"<{len(values)}{TYPES[code][0]}", *values)
        if len(body) <= 4:
            place = body.ljust(4, b"\0")
        else:
            place, tail = struct.pack("<I", after + len(tail)), tail + body + b"\0" * (len(body) % 2)
        entries += struct.pack("<HHI", tag, code, len(values)) + place
    head = struct.pack("<2sHI", b"II", 42, at) + b"".join(blocks)
    return head.ljust(at, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + tail


def cells_of(raster: Raster, meta: CubeMeta) -> pd.DataFrame:
    """Cells (x, y, bands) of a raster on a cube's grid, whose cells it must share."""
    x0, y0 = round((raster.xmin - meta.xmin) / meta.cell_w), round((meta.ymax - raster.ymax) / meta.cell_h)
    _, rows, cols = raster.values.shape
    y, x = np.indices((rows, cols))
    return pd.DataFrame({"x": x.ravel() + x0, "y": y.ravel() + y0} | {b: raster.values[i].ravel() for i, b in enumerate(meta.bands)})


def load(spark: SparkSession, pattern: str, meta: CubeMeta, kind: str = "compact") -> RasterCube:
    """A cube of GeoTIFF files; dates come from their paths. Each file is read once, on an executor."""
    def decode(content: bytes) -> pd.DataFrame:
        raster = read(content)
        if (round(raster.cell_w, 9), round(raster.cell_h, 9)) != (round(meta.cell_w, 9), round(meta.cell_h, 9)):
            raise ValueError(f"cells of {raster.cell_w} by {raster.cell_h} on a grid of {meta.cell_w} by {meta.cell_h}")
        if len(raster.values) < len(meta.bands):
            raise ValueError(f"{len(raster.values)} bands in the file, {len(meta.bands)} wanted")
        return cells_of(raster, meta).dropna(subset=list(meta.bands), how="all")

    rows = load_files(spark, pattern, decode, "x long, y long, " + ", ".join(f"`{b}` double" for b in meta.bands), kind)
    return RasterCube(rows, meta.of(has_time=True))


def files(cube: RasterCube, cells: int = 1024, by_band: bool = False, kind: str = "f4", prefix: str = "cube") -> DataFrame:
    """(name, content): a georeferenced file for each date (and band) and each square of `cells` by `cells` that has data.

    Executors encode the files, a square at a time; the names hold date, band and square.
    """
    ship(cube.df.sparkSession)
    m, bands = cube.meta, list(cube.bands)
    epsg = int(m.crs.removeprefix("EPSG:")) if m.crs.startswith("EPSG:") else None
    time = ["t"] if m.has_time else []
    squares = cube.df.withColumns({"__c": F.floor(F.col("x") / cells), "__r": F.floor(F.col("y") / cells)})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = rows["x"].min(), rows["y"].min(), rows["x"].max(), rows["y"].max()
        values = np.full((len(bands), y1 - y0 + 1, x1 - x0 + 1), np.nan)
        for i, b in enumerate(bands):
            values[i, rows["y"] - y0, rows["x"] - x0] = rows[b].astype(float)
        label = "_".join([prefix, *([str(rows["t"].iloc[0]).replace("-", "")[:8]] if time else []), f"{rows['__c'].iloc[0]}", f"{rows['__r'].iloc[0]}"])
        made = [(f"{label}_{b}.tif", values[i : i + 1]) for i, b in enumerate(bands)] if by_band else [(f"{label}.tif", values)]
        corner = {"xmin": m.xmin + float(x0) * m.cell_w, "ymax": m.ymax - float(y0) * m.cell_h, "cell_w": m.cell_w, "cell_h": m.cell_h, "epsg": epsg}
        return pd.DataFrame([(n, write(Raster(v, **corner), kind=kind)) for n, v in made], columns=["name", "content"])

    return squares.groupBy("__c", "__r", *time).applyInPandas(run, "name string, content binary")


def save(made: DataFrame, folder: str) -> int:
    """Write files (name, content) to a folder of any store that Spark can write, one at a time; their number."""
    spark = made.sparkSession
    n = 0
    for r in made.toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(r["content"]))
        finally:
            out.close()
        n += 1
    return n
