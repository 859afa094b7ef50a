"""Cube tables, product catalogues and dates in paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.meta import CubeMeta
from gridloom.operators.grid import z_order
from gridloom.ship import ship


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_cube(cube: RasterCube, path: str, mode: str = "overwrite") -> None:
    """A cube table: parquet by date, files sorted by tile number so that boxes prune row groups; metadata beside it."""
    df = cube.df.withColumn("zkey", z_order(cube))
    by = ["t"] if cube.meta.has_time else []
    df = df.repartitionByRange(*by, "zkey").sortWithinPartitions(*by, "zkey", "y", "x")
    (df.write.mode(mode).partitionBy("t") if by else df.write.mode(mode)).parquet(f"{path}/cells")
    m = cube.meta
    about = {k: getattr(m, k) for k in ("bands", "has_time", "xmin", "ymax", "cell_w", "cell_h", "tile_cols", "tile_rows", "crs", "types")}
    cube.df.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def append_cube(cube: RasterCube, path: str) -> None:
    """More dates or cells for a cube table."""
    df = cube.df.withColumn("zkey", z_order(cube)).sortWithinPartitions("zkey")
    (df.write.mode("append").partitionBy("t") if cube.meta.has_time else df.write.mode("append")).parquet(f"{path}/cells")


def read_cube(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, tiles: tuple[int, int, int, int] | None = None, bands: list[str] | None = None, allow_empty: bool = False) -> RasterCube:
    """A cube table, or what of it lies in [start, end) and a range of tile keys; filters reach the scan."""
    about = json.loads(spark.read.text(f"{path}/meta").first()[0])
    m = CubeMeta(**{k: tuple(v) if isinstance(v, list) else v for k, v in about.items()})
    df = spark.read.parquet(f"{path}/cells")
    if start is not None:
        df = df.filter(F.col("t") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("t") < F.lit(end).cast("date"))
    if tiles:
        c0, r0, c1, r1 = tiles
        df = df.filter(F.col("x").between(c0 * m.tile_cols, (c1 + 1) * m.tile_cols - 1) & F.col("y").between(r0 * m.tile_rows, (r1 + 1) * m.tile_rows - 1))
    for b in bands or []:
        if b not in m.bands:
            df = df.withColumn(b, F.lit(None).cast("double"))  # an asset that isn't there is a missing band
    if not allow_empty and df.isEmpty():
        raise ValueError("no cells in the wanted range")
    names = tuple(bands or m.bands)
    return RasterCube(df, m.of(bands=names, types=()))


#: Dates in paths.
PATH_DATES = {
    "day folders": r"/(\d{4})/(\d{2})/(\d{2})/",
    "compact": r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d{3})",
    "dashed": r"(\d{4})-(\d{2})-(\d{2})",
    "underscored": r"(\d{4})_(\d{2})_(\d{2})",
}


def path_date(path: Column, kind: str = "compact") -> Column:
    """The date in a path, missing if there is none."""
    parts = [F.regexp_extract(path, PATH_DATES.get(kind, kind), i) for i in (1, 2, 3)]
    return F.try_to_date(F.nullif(F.concat_ws("-", *parts), F.lit("--")), "yyyy-MM-dd")


def load_files(spark: SparkSession, pattern: str, decode, schema: str, kind: str = "compact") -> DataFrame:
    """Cells of raster files: decode(bytes) -> pandas rows of `schema` (without t) for each file, read once; t from the path."""
    import pandas as pd

    ship(spark)
    files = spark.read.format("binaryFile").load(pattern).select("content", path_date(F.col("path"), kind).alias("t"))

    def run(batches):
        for rows in batches:
            for content, t in zip(rows["content"], rows["t"], strict=True):
                cells = decode(bytes(content))
                cells["t"] = t
                yield pd.DataFrame(cells)

    return files.mapInPandas(run, schema + ", t date")


def search(products: DataFrame, start: str | None = None, end: str | None = None, box: tuple[int, int, int, int] | None = None, equal: dict | None = None, at_most: dict | None = None, label: Column | None = None) -> DataFrame:
    """Products of a catalogue (product, t, tcol, trow, ...) by dates [start, end), tiles, properties and a date condition."""
    df = products
    if start:
        df = df.filter(F.col("t") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("t") < F.lit(end).cast("date"))
    if box:
        df = df.filter(F.col("tcol").between(box[0], box[2]) & F.col("trow").between(box[1], box[3]))
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name) == value)
    for name, value in (at_most or {}).items():
        df = df.filter(F.col(name) <= value)
    return df if label is None else df.filter(label)


def stac_products(items: DataFrame, column: str = "value") -> DataFrame:
    """(product, t, xmin, ymin, xmax, ymax, assets) of STAC items or catalogue features, one JSON text each."""
    kind = "struct<id: string, bbox: array<double>, properties: struct<datetime: string>, assets: map<string, struct<href: string>>>"
    f = F.from_json(column, kind)
    at = F.try_to_timestamp(F.substring(f["properties"]["datetime"], 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("date")
    return items.select(f["id"].alias("product"), at.alias("t"), *(f["bbox"][i].alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))), F.transform_values(f["assets"], lambda k, v: v["href"]).alias("assets"))
