"""Sinks: tables by date or feature, statistics, features, rendered tiles, a plain TIFF for small cubes."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.operators.vector import to_geojson


def write_by(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """Parquet folders by date, feature or tile."""
    df.repartition(by).write.mode(mode).partitionBy(by).parquet(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """One CSV file with a header; missing values are empty."""
    stats.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def statistics_json(stats: DataFrame, bands: list[str]) -> DataFrame:
    """(t, json): for each date a text {feature: [band values]}."""
    entry = F.struct(F.col("feature_index").cast("string").alias("key"), F.array(*(F.col(b).cast("double") for b in bands)).alias("value"))
    return stats.groupBy("t").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def write_features(features: DataFrame, path: str, crs: str = "grid") -> None:
    """GeoJSON features, one to a line."""
    to_geojson(features, crs).write.mode("overwrite").text(path)


def rendered(cube: RasterCube, low: float, high: float, alpha: bool = True) -> DataFrame:
    """Bands as 1..255 (0 for missing), and an alpha band that is 0 where all are missing."""
    def level(b: str):
        scaled = 1 + F.rint((F.least(F.greatest(F.col(b), F.lit(low)), F.lit(high)) - low) / (high - low) * 254)
        return F.when(F.col(b).isNull(), 0).otherwise(scaled).cast("smallint").alias(b)

    extra = [F.when(F.coalesce(*cube.bands).isNull(), 0).otherwise(255).cast("smallint").alias("alpha")] if alpha else []
    return cube.df.select(*cube.keys, *(level(b) for b in cube.bands), *extra)


def decibels(cube: RasterCube, band: str) -> RasterCube:
    return cube.with_bands({b: 10 * F.log10(F.when(F.col(b) > 0, F.col(b))) if b == band else F.col(b) for b in cube.bands})


def colour_map(breaks: list[tuple[float, int]], band: str, fallback: int = 0):
    """A column of colours: that of the first break at or above a value."""
    out = None
    for limit, colour in sorted(breaks):
        out = F.when(F.col(band) <= limit, colour) if out is None else out.when(F.col(band) <= limit, colour)
    return F.when(F.col(band).isNull(), 0).otherwise(out.otherwise(fallback))


def stitched(cube: RasterCube, limit: int = 4_000_000) -> np.ndarray:
    """A small cube without time as an array (bands, rows, cols), NaN where missing; refuses more than `limit` cells."""
    edge = cube.df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if edge[0] is None:
        return np.empty((len(cube.bands), 0, 0))
    x0, x1, y0, y1 = edge
    if (x1 - x0 + 1) * (y1 - y0 + 1) > limit:
        raise ValueError(f"more than {limit} cells; write a cube table instead")
    out = np.full((len(cube.bands), y1 - y0 + 1, x1 - x0 + 1), np.nan)
    for r in cube.df.select("x", "y", *cube.bands).toLocalIterator():
        out[:, r[1] - y0, r[0] - x0] = [np.nan if v is None else float(v) for v in r[2:]]
    return out


def tiff(values: np.ndarray) -> bytes:
    """An uncompressed float32 TIFF of (bands, rows, cols), little-endian, bands in planes."""
    bands, rows, cols = values.shape
    data = values.astype("<f4").tobytes()
    plane = rows * cols * 4
    tags = [(256, 3, 1, cols), (257, 3, 1, rows), (258, 3, bands, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, bands, 8), (277, 3, 1, bands), (278, 3, 1, rows), (279, 4, bands, plane), (284, 3, 1, 2), (339, 3, bands, 3)]
    at, tail, entries = 8 + len(data), b"", []
    after = at + 2 + 12 * len(tags) + 4
    for tag, kind, n, value in tags:
        size = {3: 2, 4: 4}[kind]
        items = [8 + i * plane for i in range(bands)] if tag == 273 else [value] * n
        packed = struct.pack(f"<{n}{'H' if kind == 3 else 'I'}", *items)
        if n * size <= 4:
            entries.append(struct.pack("<HHI", tag, kind, n) + packed.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, n, after + len(tail)))
            tail += packed
    return struct.pack("<2sHI", b"II", 42, at) + data + struct.pack("<H", len(tags)) + b"".join(entries) + struct.pack("<I", 0) + tail
