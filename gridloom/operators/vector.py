"""Regions, distances and features from GeoJSON."""

from __future__ import annotations

import json
import re
import struct
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.operators.grid import transform
from gridloom.operators.zonal import cells_in, polygons, touched
from gridloom.ship import ship


def _scratch(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir. Only a local session may do without it, in a folder of its own."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = f"{tempfile.gettempdir()}/gridloom-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    _scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def regions(cube: RasterCube, band: int | str = 0) -> DataFrame:
    """(x, y[, t], value, region): 4-connected regions of equal values; region is the smallest cell number in it.

    Neighbours are found by joins on the keys; labels spread by alternating stars, so the rounds grow with the logarithm
    of a region's length rather than with its length.
    """
    time = ["t"] if cube.meta.has_time else []
    number = F.concat_ws(":", *(F.lpad((F.col(k) if k == "t" else F.col(k) + (1 << 31)).cast("string"), 12, "0") for k in [*time, "y", "x"]))
    cells = cut(cube.df.select("x", "y", *time, F.col(cube.band(band)).alias("value"), number.alias("id")).filter("value is not null"))
    sides = []
    for dx, dy in ((1, 0), (0, 1)):
        near = cells.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), *time, "value", F.col("id").alias("v"))
        sides.append(cells.withColumnRenamed("id", "u").join(near, ["x", "y", *time, "value"]).select("u", "v"))
    roots = spread(sides[0].unionByName(sides[1]))
    found = cells.join(roots.withColumnRenamed("node", "id"), "id", "left")
    return found.select("x", "y", *time, "value", F.coalesce("root", "id").alias("region"))


def spread(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (u, v) reach."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def vectorize(cube: RasterCube, band: int | str = 0) -> DataFrame:
    """One row for each region: id `<yyyyMMdd_>band<n>_<i>`, value, cells, its box and its edges as line pieces.

    The pieces are the borders between a region's cells and others, with the region to their left; with_rings joins them.
    """
    m = cube.meta
    time = ["t"] if m.has_time else []
    cells = cut(regions(cube, band))
    sides = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    out = cells.select("*", F.inline(sides)).withColumns({"nx": F.col("x") + F.col("dx"), "ny": F.col("y") + F.col("dy")})
    other = cells.select(F.col("x").alias("nx"), F.col("y").alias("ny"), *time, F.col("region").alias("other"))
    border = out.join(other, ["nx", "ny", *time], "left").filter("other is null or other <> region")
    left, top = m.xmin + F.col("x") * m.cell_w, m.ymax - F.col("y") * m.cell_h
    right, bottom = left + m.cell_w, top - m.cell_h
    # Counterclockwise around each cell: up the right side, back along the top, down the left, on along the bottom.
    x0 = F.when((F.col("dx") == 1) | (F.col("dy") == -1), right).otherwise(left)
    x1 = F.when((F.col("dx") == 1) | (F.col("dy") == 1), right).otherwise(left)
    y0 = F.when((F.col("dx") == 1) | (F.col("dy") == 1), bottom).otherwise(top)
    y1 = F.when((F.col("dx") == 1) | (F.col("dy") == -1), top).otherwise(bottom)
    pieces = border.groupBy("region").agg(F.count("*").alias("edges"), F.collect_list(F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))).alias("outline"))
    size = cells.groupBy("region", "value", *time).agg(
        F.count("*").alias("cells"), (m.xmin + F.min("x") * m.cell_w).alias("xmin"), (m.ymax - (F.max("y") + 1) * m.cell_h).alias("ymin"),
        (m.xmin + (F.max("x") + 1) * m.cell_w).alias("xmax"), (m.ymax - F.min("y") * m.cell_h).alias("ymax"),
    )
    name = F.concat(F.concat(F.date_format("t", "yyyyMMdd"), F.lit("_")) if time else F.lit(""), F.lit(f"band{cube.bands.index(cube.band(band))}_"), "region")
    return size.join(pieces, "region").withColumn("id", name)


def trace(pieces: list) -> list[list[list[float]]]:
    """Rings of directed pieces (x0, y0, x1, y1) with the region to their left: the outer ring first, then holes.

    Where two rings touch, a ring turns left, around its own cell. Corners only; a ring ends where it starts.
    """
    ahead: dict[tuple, list[tuple]] = {}
    for x0, y0, x1, y1 in pieces:
        ahead.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    while ahead:
        start = next(iter(ahead))
        ring, at, way = [], start, None
        while at in ahead:
            ends = ahead[at]
            if way is not None and len(ends) > 1:
                ends.sort(key=lambda p: way[0] * (p[1] - at[1]) - way[1] * (p[0] - at[0]))
            end = ends.pop()
            if not ends:
                del ahead[at]
            step = (end[0] - at[0], end[1] - at[1])
            if way is None or way[0] * step[1] != way[1] * step[0] or way[0] * step[0] < 0 or way[1] * step[1] < 0:
                ring.append(at)
            at, way = end, step
            if at == start:
                break
        first = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1]) if len(ring) > 1 else (0, 0)
        if way[0] * first[1] == way[1] * first[0]:
            ring = ring[1:]  # the start lies on a side
        rings.append([list(p) for p in [*ring, ring[0]]])
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))
    return sorted(rings, key=area, reverse=True)


def with_rings(features: DataFrame) -> DataFrame:
    """Rows of vectorize with `rings`: the outer ring and the holes of each region."""
    ship(features.sparkSession)

    @F.pandas_udf("array<array<array<double>>>")
    def rings(outlines: pd.Series) -> pd.Series:
        return outlines.map(lambda o: trace([(p["x0"], p["y0"], p["x1"], p["y1"]) for p in o]))

    return features.withColumn("rings", rings("outline"))


def to_geojson(features: DataFrame, crs: str = "grid") -> DataFrame:
    """One JSON text, a polygon feature with box and reference system, for each row of vectorize."""
    made = F.struct(F.lit("Feature").alias("type"), "id", F.struct("value", "cells").alias("properties"), F.array("xmin", "ymin", "xmax", "ymax").alias("bbox"), F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"), F.lit(crs).alias("crs"))
    return with_rings(features).select(F.to_json(made).alias("feature"))


def euclidean_distance(cube: RasterCube, points: DataFrame, block: int = 32) -> RasterCube:
    """Distance from each cell's centre to the nearest of the points (px, py).

    Points and cells meet in blocks of cells. Points of one cell nearest to its corners aren't told apart: all are kept,
    but distinct. Cells look into the blocks around theirs, ring by ring; a cell is settled once its nearest point lies
    nearer than the next ring can reach. Each round looks at cells that aren't settled, at double the reach.
    """
    m = cube.meta
    cx, cy = m.centre()
    px, py = m.cell_of(F.col("px"), F.col("py"))
    at = cut(points.select("px", "py", F.floor(px / block).alias("bx"), F.floor(py / block).alias("by")).distinct())
    edge = at.agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1")).first()
    open_ = cut(cube.df.select("x", "y").distinct().withColumns({"bx": F.floor(F.col("x") / block), "by": F.floor(F.col("y") / block)}))
    if edge.x0 is None:
        return cube.on(open_.select("x", "y", F.lit(None).cast("double").alias("distance")), has_time=False, bands=("distance",), types=())
    settled, reach = [], 1
    while True:
        spans = [F.sequence(F.greatest(F.col(c) - reach, F.lit(low)), F.least(F.col(c) + reach, F.lit(high))) for c, low, high in (("bx", edge.x0, edge.x1), ("by", edge.y0, edge.y1))]
        # Blocks of cells, not cells, are repeated for the blocks they look into.
        homes = open_.select("bx", "by").distinct()
        homes = homes.filter((F.col("bx") + reach >= edge.x0) & (F.col("bx") - reach <= edge.x1) & (F.col("by") + reach >= edge.y0) & (F.col("by") - reach <= edge.y1))
        seen = homes.select("bx", "by", F.explode(spans[0]).alias("qx"), spans[1].alias("ys")).select("bx", "by", "qx", F.explode("ys").alias("qy"))
        near = seen.join(at.select(F.col("bx").alias("qx"), F.col("by").alias("qy"), "px", "py"), ["qx", "qy"]).select("bx", "by", "px", "py")
        found = open_.join(near, ["bx", "by"]).groupBy("x", "y", "bx", "by").agg(F.min(F.hypot(cx - F.col("px"), cy - F.col("py"))).alias("distance"))
        found = open_.join(found, ["x", "y", "bx", "by"], "left")
        whole = (F.col("bx") - reach <= edge.x0) & (F.col("bx") + reach >= edge.x1) & (F.col("by") - reach <= edge.y0) & (F.col("by") + reach >= edge.y1)
        done = whole | (F.col("distance") <= reach * block * min(m.cell_w, m.cell_h))
        found = cut(found.withColumn("done", F.coalesce(done, F.lit(False))))
        settled.append(found.filter("done").select("x", "y", "distance"))
        open_ = found.filter("not done").select("x", "y", "bx", "by")
        if open_.isEmpty():
            break
        reach *= 2
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return cube.on(out, has_time=False, bands=("distance",), types=())


def cost_distance(cube: RasterCube, points: DataFrame, max_distance: float, band: int | str = 0) -> RasterCube:
    """Least accumulated cost from the points (px, py) over friction cells, up to max_distance.

    A step to one of 8 neighbours costs its length times the mean friction of both cells. Rounds of relaxation go on
    until nothing changes. A round writes only the cells that it improved (the frontier of the next one), not the whole
    table; a cell's cost is the least of all rounds, and every KEEP rounds those written so far are merged.
    """
    m = cube.meta
    b = cube.band(band)
    cost = cut(cube.df.select("x", "y", F.col(b).cast("double").alias("f")).filter("f is not null"))
    px, py = m.cell_of(F.col("px"), F.col("py"))
    front = cut(cost.join(points.select(px.alias("x"), py.alias("y")).distinct(), ["x", "y"]).select("x", "y", F.lit(0.0).alias("d")))
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit((dx * dx * m.cell_w**2 + dy * dy * m.cell_h**2) ** 0.5).alias("s")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    best = front
    written = 1
    while not front.isEmpty():
        spread_ = front.join(cost, ["x", "y"]).select("*", F.inline(steps)).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "d", F.col("f").alias("g"), "s")
        reached = spread_.join(cost, ["x", "y"]).select("x", "y", (F.col("d") + F.col("s") * (F.col("f") + F.col("g")) / 2).alias("d")).filter(F.col("d") <= max_distance)
        reached = reached.groupBy("x", "y").agg(F.min("d").alias("d"))
        known = best.groupBy("x", "y").agg(F.min("d").alias("old"))
        front = cut(reached.join(known, ["x", "y"], "left").filter("old is null or d < old - 1e-12").select("x", "y", "d"))
        best, written = best.unionByName(front), written + 1
        if written == KEEP:
            best, written = cut(best.groupBy("x", "y").agg(F.min("d").alias("d"))), 1
    best = best.groupBy("x", "y").agg(F.min("d").alias("d"))
    return cube.on(best.select("x", "y", F.col("d").alias("cost")), has_time=False, bands=("cost",), types=())


#: Rounds of cost_distance after which the frontiers written so far become one table.
KEEP = 16

GEOJSON = "struct<type: string, features: array<struct<type: string, id: string, properties: map<string, double>, geometry: struct<type: string, coordinates: string>>>>"


def read_geojson(texts: DataFrame, column: str = "value") -> DataFrame:
    """(feature_index, xmin, ymin, xmax, ymax, rings, properties) of the polygons of a FeatureCollection in each text.

    rings are those of all parts of a Polygon or MultiPolygon, holes included. A feature without geometry, or with
    another one, is an error.
    """
    parsed = texts.select(F.from_json(column, GEOJSON).alias("g")).select(F.posexplode("g.features").alias("feature_index", "f"))
    kind, body = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(body, "array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(F.from_json(body, "array<array<array<array<double>>>>")))
    rings = F.coalesce(rings, F.raise_error(F.concat(F.lit("no polygon in feature "), F.col("feature_index").cast("string"))).cast("array<array<array<double>>>"))
    corners = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    rows = parsed.select(F.col("feature_index").cast("int").alias("feature_index"), corners.alias("rings"), F.col("f.properties").alias("properties"))
    return with_box(rows)


def with_box(features: DataFrame) -> DataFrame:
    """Features with the box of their rings, in the usual order of columns."""
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    rest = [c for c in features.columns if c not in ("feature_index", "xmin", "ymin", "xmax", "ymax", "rings")]
    return features.select("feature_index", F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"), "rings", *rest)


def reproject_features(features: DataFrame, source: str, target: str) -> DataFrame:
    """Features in another reference system, corner by corner; a feature without rings becomes the ring of its box."""
    def corner(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    box = F.array(F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")))

    def moved(p: Column) -> Column:
        x, y = transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return with_box(features.withColumn("rings", F.transform(F.coalesce("rings", box), lambda r: F.transform(r, moved))))


def vector_to_raster(features: DataFrame, cells: DataFrame, meta, partial: bool = False) -> DataFrame:
    """(x, y, t, band, value): properties `<instant>~<band>` or `<band>` of features, burnt to the cells (x, y).

    A property without an instant has a missing t. Later features win where two overlap. partial: cells that an edge passes
    count, too.
    """
    properties = features.select("feature_index", F.explode("properties").alias("key", "value"))
    dated = F.regexp_extract("key", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})Z?~(.*)$", 1)
    name = F.regexp_extract("key", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?~(.*)$", 1)
    properties = properties.select("feature_index", F.try_to_timestamp(F.nullif(dated, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("t"), F.when(dated == "", F.col("key")).otherwise(name).alias("band"), "value")
    held = burnt_cells(features, cells, meta, partial)
    return held.join(properties, "feature_index").groupBy("x", "y", "t", "band").agg(F.max_by("value", "feature_index").alias("value"))


def burnt_cells(features: DataFrame, cells: DataFrame, meta, partial: bool = False) -> DataFrame:
    grid = RasterCube(cells.select("x", "y").distinct(), meta.of(bands=(), has_time=False))
    return (touched if partial else cells_in)(grid, features.select("feature_index", "xmin", "ymin", "xmax", "ymax", "rings"))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_wkt(text: str) -> list[list[tuple[float, float]]]:
    """Rings of POLYGON and MULTIPOLYGON (all parts, holes included), points of POINT and MULTIPOINT, lines of LINESTRING and MULTILINESTRING."""
    kind, _, body = text.strip().partition("(")
    kind = kind.strip().upper().split(" ")[0]
    if kind not in ("POLYGON", "MULTIPOLYGON", "POINT", "MULTIPOINT", "LINESTRING", "MULTILINESTRING"):
        raise ValueError(f"unknown geometry {kind}")
    # Corners become [x, y], brackets nest as they do in the text.
    nested = re.sub(rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*", lambda m: f"[{float(m[1])},{float(m[2])}]", "(" + body)
    found = json.loads(nested.replace("(", "[").replace(")", "]"))

    def lists(part: list) -> list[list]:
        if isinstance(part[0][0], float):
            return [part]
        return [ring for inner in part for ring in lists(inner)]

    if kind == "MULTIPOINT":
        found = [p[0] if isinstance(p[0], list) else p for p in found]
    return [[(x, y) for x, y in part] for part in lists(found)]


def parse_wkb(data: bytes) -> list[list[tuple[float, float]]]:
    """As parse_wkt, for the binary form."""
    at = 0

    def read(form: str) -> tuple:
        nonlocal at
        values = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return values

    def geometry() -> list[list[tuple[float, float]]]:
        order = "<" if read("<B")[0] else ">"
        (kind,) = read(order + "I")
        if kind == 1:
            return [[read(order + "2d")]]

        def corners() -> list[tuple[float, float]]:
            return [read(order + "2d") for _ in range(read(order + "I")[0])]

        if kind == 2:
            return [corners()]
        (n,) = read(order + "I")
        if kind == 3:
            return [corners() for _ in range(n)]
        if kind in (4, 5, 6, 7):
            return [ring for _ in range(n) for ring in geometry()]
        raise ValueError(f"unknown geometry {kind}")

    return geometry()


def read_shapes(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The parts of each polygon, line or point of a shapefile's main file (.shp), in its order; null shapes have none."""
    if struct.unpack_from(">I", data, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at < len(data):
        (length,) = struct.unpack_from(">I", data, at + 4)
        at += 8
        (kind,) = struct.unpack_from("<I", data, at)
        if kind in (1, 11, 21):
            out.append([[struct.unpack_from("<2d", data, at + 4)]])
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, corners = struct.unpack_from("<2I", data, at + 36)
            starts = [*struct.unpack_from(f"<{parts}I", data, at + 44), corners]
            flat = struct.unpack_from(f"<{2 * corners}d", data, at + 44 + 4 * parts)
            out.append([[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)])
        elif kind == 0:
            out.append([])
        else:
            raise ValueError(f"unknown shape {kind}")
        at += 2 * length
    return out


def features_of_wkt(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A feature for each POLYGON or MULTIPOLYGON."""
    return polygons(spark, [parse_wkt(text) for text in texts])


def lines_of_wkt(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(feature_index, line) of LINESTRING and MULTILINESTRING texts, a row for each part."""
    return spark.createDataFrame([(i, part) for i, text in enumerate(texts) for part in parse_wkt(text)], "feature_index int, line array<struct<x: double, y: double>>")


def intersecting(left: DataFrame, right: DataFrame, block: float) -> DataFrame:
    """(left_index, right_index) of features that intersect: an edge of one crosses one of the other, or one holds the other.

    Features meet in square blocks of coordinates that both boxes touch, by equality; then corners and edges are tested.
    """
    def keyed(features: DataFrame, mark: str) -> DataFrame:
        def corner(x: str, y: str) -> Column:
            return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

        box = F.array(F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")))
        spans = [F.sequence(F.floor(F.col(a) / block).cast("long"), F.floor(F.col(b) / block).cast("long")) for a, b in (("xmin", "xmax"), ("ymin", "ymax"))]
        rows = features.select(F.col("feature_index").alias(f"{mark}_index"), F.struct("xmin", "ymin", "xmax", "ymax", F.coalesce("rings", box).alias("rings")).alias(mark), spans[0].alias("bx"), spans[1].alias("by"))
        return rows.withColumn("bx", F.explode("bx")).withColumn("by", F.explode("by"))

    met = keyed(left, "left").join(keyed(right, "right"), ["bx", "by"])
    a, b = F.col("left"), F.col("right")
    met = met.filter((a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])).dropDuplicates(["left_index", "right_index"])

    def sides(ring: Column) -> Column:
        return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def turn(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def cross(s: Column, u: Column) -> Column:
        touch = (F.greatest(s["p"]["x"], s["q"]["x"]) >= F.least(u["p"]["x"], u["q"]["x"])) & (F.greatest(u["p"]["x"], u["q"]["x"]) >= F.least(s["p"]["x"], s["q"]["x"]))
        touch = touch & (F.greatest(s["p"]["y"], s["q"]["y"]) >= F.least(u["p"]["y"], u["q"]["y"])) & (F.greatest(u["p"]["y"], u["q"]["y"]) >= F.least(s["p"]["y"], s["q"]["y"]))
        return touch & (turn(s["p"], s["q"], u["p"]) * turn(s["p"], s["q"], u["q"]) <= 0) & (turn(u["p"], u["q"], s["p"]) * turn(u["p"], u["q"], s["q"]) <= 0)

    def holds(rings: Column, point: Column) -> Column:
        def crossed(s: Column) -> Column:
            p, q = s["p"], s["q"]
            return F.when(((p["y"] > point["y"]) != (q["y"] > point["y"])) & (point["x"] < p["x"] + (point["y"] - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])), 1).otherwise(0)

        return F.aggregate(F.flatten(F.transform(rings, sides)), F.lit(0), lambda n, s: n + crossed(s)) % 2 == 1

    met = met.withColumns({"ls": F.flatten(F.transform(a["rings"], sides)), "rs": F.flatten(F.transform(b["rings"], sides))})
    edges = F.exists("ls", lambda s: F.exists("rs", lambda u: cross(s, u)))
    inside = holds(a["rings"], b["rings"][0][0]) | holds(b["rings"], a["rings"][0][0])
    return met.filter(edges | inside).select("left_index", "right_index")
