"""Statistics of cells within features.

Features are rows (feature_index, xmin, ymin, xmax, ymax, rings) in the cube's coordinates. A feature is first matched to
blocks of cells by its box (an equi-join on block keys), then cells are tested: in the half-open box for boxes, by
crossing count at the cell's centre over all rings, so that holes are left out and all parts count. A cell in two features
counts for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.functions import series

#: Cells on the edge of the blocks in which features and cells meet.
BLOCK = 64
FEATURE = "feature_index int, xmin double, ymin double, xmax double, ymax double, rings array<array<struct<x: double, y: double>>>"


def boxes(spark: SparkSession, spans: list[tuple[float, float, float, float]]) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, s), None) for i, s in enumerate(spans)], FEATURE)


def polygons(spark: SparkSession, shapes: list) -> DataFrame:
    """Shapes: a ring of corners, or a list of rings (outer rings of all parts, and holes); a ring needn't repeat its first corner."""
    rows = []
    for i, shape in enumerate(shapes):
        rings = [shape] if isinstance(shape[0][0], (int, float)) else shape
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        rows.append((i, float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)), [[(float(p[0]), float(p[1])) for p in r] for r in rings]))
    return spark.createDataFrame(rows, FEATURE)


def points(spark: SparkSession, at: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "feature_index int, px double, py double")


def in_box(cx: Column, cy: Column) -> Column:
    return (cx >= F.col("xmin")) & (cx < F.col("xmax")) & (cy >= F.col("ymin")) & (cy < F.col("ymax"))


def within(cx: Column, cy: Column) -> Column:
    """Whether a coordinate lies in the feature of the row."""
    rings = F.col("rings")

    def crosses(a: Column, b: Column) -> Column:
        passes = (a["y"] > cy) != (b["y"] > cy)
        return F.when(passes & (cx < a["x"] + (cy - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])), 1).otherwise(0)

    def crossed(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.aggregate(F.zip_with(ring, after, crosses), F.lit(0), lambda s, v: s + v)

    hits = F.aggregate(rings, F.lit(0), lambda s, ring: s + crossed(ring))
    return in_box(cx, cy) & (rings.isNull() | (hits % 2 == 1))


#: Listed tables (features, dates, labels, spans) up to this number of rows are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 10_000


def small(listed: DataFrame) -> DataFrame:
    """A caller's listed table, broadcast after a look at its size."""
    return F.broadcast(listed) if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else listed


def _met(cube: RasterCube, features: DataFrame) -> DataFrame:
    """The cube's rows beside each feature whose box touches their block of cells."""
    m = cube.meta
    low_x, high_x = (F.floor((F.col(c) - m.xmin) / m.cell_w / BLOCK).cast("long") for c in ("xmin", "xmax"))
    low_y, high_y = (F.floor((m.ymax - F.col(c)) / m.cell_h / BLOCK).cast("long") for c in ("ymax", "ymin"))
    keyed = features.withColumn("__bx", F.explode(F.sequence(low_x, high_x))).withColumn("__by", F.explode(F.sequence(low_y, high_y)))
    cells = cube.df.withColumns({"__bx": F.floor(F.col("x") / BLOCK), "__by": F.floor(F.col("y") / BLOCK)})
    return cells.join(keyed, ["__bx", "__by"])


def cells_in(cube: RasterCube, features: DataFrame) -> DataFrame:
    """The cube's rows once for each feature that holds their centres, with feature_index."""
    return _met(cube, features).filter(within(*cube.meta.centre())).select("feature_index", *cube.keys, *cube.bands)


def zonal_reducer(name: str, v: Column, order: Column) -> Column:
    """Reducers of zonal statistics: a count without values is 0."""
    if name == "count":
        return F.count(v)
    return series.reducer(name, v, order)


def counted(condition: dict, v: Column) -> Column:
    """Cells for which a process graph on the value holds."""
    from gridloom.plans.graph import compile_bands

    return F.count(F.when(compile_bands(condition, [v], ["value"])[0], F.lit(1)))


def aggregate_spatial(cube: RasterCube, features: DataFrame, reducers: list[str], all_features: bool = True, probabilities: list[float] | None = None, conditions: dict[str, dict] | None = None) -> DataFrame:
    """One row for each feature (and date): columns <band>_<reducer>, quantiles as <band>_q<percent>.

    conditions: process graphs on a cell's value; cells for which one holds are counted as <band>_<name>_count.

    Rows whose bands are all missing don't reach the aggregation unless a count needs them; with all_features, a feature
    gets a row for each date of the cube all the same.
    """
    groups = ["t", "feature_index"] if cube.meta.has_time else ["feature_index"]
    rows = cells_in(cube, features)
    if not any(r.startswith("count") for r in reducers):
        rows = rows.filter(F.coalesce(*(F.col(b).cast("double") for b in cube.bands)).isNotNull())
    # Cells of a feature have an order, so that first and last are the same in each run.
    order = F.struct("y", "x")
    made = [zonal_reducer(r, F.col(b), order).alias(f"{b}_{r}") for b in cube.bands for r in reducers]
    for p in probabilities or []:
        made += [F.percentile_approx(b, p, 100000).alias(f"{b}_q{round(p * 100)}") for b in cube.bands]
    for name, graph in (conditions or {}).items():
        made += [counted(graph, F.col(b)).alias(f"{b}_{name}_count") for b in cube.bands]
    found = rows.groupBy(*groups).agg(*made)
    if not all_features:
        return found
    wanted = features.select("feature_index")
    if cube.meta.has_time:
        wanted = cube.df.select("t").distinct().join(small(wanted))  # dates by listed features
    out = wanted.join(found, groups, "left")
    zero = [c for c in out.columns if c.endswith(("_count", "_count_all"))]
    return out.fillna(0, zero) if zero else out


def time_series(cube: RasterCube, features: DataFrame, reducer: str | list[str]) -> DataFrame:
    """(t, value) of the first band over all features' cells; with a list of reducers a column for each of them."""
    held = cells_in(cube, features).dropDuplicates(cube.keys)
    v, order = F.col(cube.bands[0]), F.struct("y", "x")
    if isinstance(reducer, str):
        return held.groupBy("t").agg(series.reducer(reducer, v, order).alias("value"))
    return held.groupBy("t").agg(*(zonal_reducer(r, v, order).alias(r) for r in reducer))


def histogram_series(cube: RasterCube, features: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(t, bin, n): for each date, cells of the first band in any feature, by equal bins between low and high."""
    held = mask_features(cube, features)
    return value_histogram(held, low, high, bins)


def running_totals(cube: RasterCube, features: DataFrame) -> DataFrame:
    """For each feature and band: sum, valid and total cells."""
    return cells_in(cube, features).groupBy("feature_index").agg(*(c for b in cube.bands for c in (F.sum(b).alias(f"{b}_sum"), F.count(b).alias(f"{b}_valid"), F.count("*").alias(f"{b}_total"))))


def histogram(cube: RasterCube, features: DataFrame, band: int | str = 0, with_nodata: bool = False, digits: int = 0) -> DataFrame:
    """(feature_index, value, n): cells by rounded value; missing ones as a value of their own if wanted."""
    rows = cells_in(cube, features).select("feature_index", F.round(cube.band(band), digits).alias("value"))
    return (rows if with_nodata else rows.filter("value is not null")).groupBy("feature_index", "value").agg(F.count("*").alias("n"))


def physical_mean(total: Column, valid: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return F.when(valid > 0, total / valid * scale + offset)


def point_values(cube: RasterCube, at: DataFrame, method: str = "nearest") -> DataFrame:
    """Bands at points (feature_index, px, py): of the cell, or bilinear between the four cells around.

    A point without a cell gets one row with missing bands, and a missing date in a cube with time.
    """
    m = cube.meta
    out = ["feature_index", *(["t"] if m.has_time else []), *cube.bands]
    if method == "nearest":
        cx, cy = m.cell_of(F.col("px"), F.col("py"))
        return at.withColumns({"x": cx, "y": cy}).join(cube.df, ["x", "y"], "left").select(out)
    gx, gy = (F.col("px") - m.xmin) / m.cell_w - 0.5, (m.ymax - F.col("py")) / m.cell_h - 0.5
    corner = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    four = at.withColumns({"__gx": gx, "__gy": gy}).select("*", F.inline(corner))
    fx, fy = F.col("__gx") - F.floor("__gx"), F.col("__gy") - F.floor("__gy")
    four = four.withColumns({"x": (F.floor("__gx") + F.col("i")).cast("long"), "y": (F.floor("__gy") + F.col("j")).cast("long"), "w": F.when(F.col("i") == 1, fx).otherwise(1 - fx) * F.when(F.col("j") == 1, fy).otherwise(1 - fy)})
    found = four.filter("w > 0").join(cube.df, ["x", "y"], "left").groupBy("feature_index", *(["t"] if m.has_time else []))
    return found.agg(*((F.sum(F.col(b) * F.col("w")) / F.nullif(F.sum(F.when(F.col(b).isNotNull(), F.col("w"))), F.lit(0.0))).alias(b) for b in cube.bands)).select(out)


def mask_features(cube: RasterCube, features: DataFrame) -> RasterCube:
    """Only the cells in any feature."""
    keys = cells_in(cube, features).select(cube.keys).distinct()
    return cube.on(cube.df.join(keys, cube.keys, "left_semi"))


def group_by_feature(cube: RasterCube, features: DataFrame, mask_value: float | None = None) -> DataFrame:
    """Each feature's box of cells: feature_index, keys, bands; cells outside of the rings are missing or mask_value."""
    inside = within(*cube.meta.centre())
    held = _met(cube, features).filter(in_box(*cube.meta.centre()))
    return held.select("feature_index", *cube.keys, *(F.when(inside, F.col(b)).otherwise(F.lit(mask_value)).alias(b) for b in cube.bands))


def merge_features(grouped: DataFrame, cube: RasterCube) -> RasterCube:
    """group_by_feature back as a cube: of several features the lowest with data wins."""
    picked = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("feature_index"))).alias(b) for b in cube.bands]
    return cube.on(grouped.groupBy(*cube.keys).agg(*picked))


def rasterize(cube_keys: DataFrame, meta, features: DataFrame, values: DataFrame | None = None, constant: float = 1.0, partial: bool = False) -> RasterCube:
    """Cells (x, y of cube_keys) in features, burnt with a constant or each feature's value; the highest zindex wins.

    values: feature_index, value, zindex and, for a cube with time, t. partial: cells that an edge passes count, too.
    """
    cells = RasterCube(cube_keys.select("x", "y").distinct(), meta.of(bands=(), has_time=False))
    held = touched(cells, features) if partial else cells_in(cells, features)
    if values is None:
        return RasterCube(held.select("x", "y").distinct().withColumn("value", F.lit(float(constant))), meta.of(bands=("value",), has_time=False))
    timed = "t" in values.columns
    burnt = held.join(values, "feature_index").groupBy("x", "y", *(["t"] if timed else [])).agg(F.max_by("value", F.struct("zindex", "feature_index")).alias("value"))
    return RasterCube(burnt, meta.of(bands=("value",), has_time=timed))


def cell_counts(cube: RasterCube, band: int | str = 0, features: DataFrame | None = None) -> DataFrame:
    """(value, n) of the whole numbers in a band."""
    rows = cube.df if features is None else mask_features(cube, features).df
    return rows.select(F.col(cube.band(band)).cast("int").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def min_max(cube: RasterCube) -> DataFrame:
    return cube.df.agg(*(c for b in cube.bands for c in (F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"))))


def quantile_breaks(cube: RasterCube, n: int, band: int | str = 0, exact: bool = True, bins: int = 4096) -> DataFrame:
    """(rank, value): upper limits of n classes with equal numbers of cells, linear between neighbouring ranks.

    Exact breaks take two passes: a histogram of equal bins (one row a bin, combined before the shuffle) tells in which
    bins the wanted ranks lie, and only the cells of those bins are ranked.
    """
    b, cuts = cube.band(band), [(i + 1) / n for i in range(n)]
    if not exact:
        held = cube.df.agg(F.percentile_approx(b, cuts, 10000).alias("__q"))
        return held.select(F.posexplode("__q").alias("rank", "value"))
    values = cube.df.select(F.col(b).cast("double").alias("v")).filter("v is not null")
    edge = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    if not edge.n:
        return values.sparkSession.createDataFrame([], "rank int, value double")
    width = (edge.high - edge.low) / bins
    at = F.least(F.floor((F.col("v") - edge.low) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    counts = sorted(values.groupBy(at.alias("bin")).count().collect())  # at most `bins` rows
    wanted = []  # (rank, position, lower index, bin, index within the bin)
    for i, c in enumerate(cuts):
        place = c * (edge.n - 1)
        for index in {int(place), min(int(place) + 1, edge.n - 1)}:
            below = 0
            for bin_, size in counts:
                if index < below + size:
                    wanted.append((i, place, index, bin_, index - below))
                    break
                below += size
    spark = values.sparkSession
    listed = spark.createDataFrame(wanted, "rank int, place double, index long, bin int, at long")
    hit = values.withColumn("bin", at).filter(F.col("bin").isin(sorted({w[3] for w in wanted})))
    ranked = hit.groupBy("bin", "v").agg(F.count("*").alias("k"))
    ranked = ranked.withColumn("upto", F.sum("k").over(W.partitionBy("bin").orderBy("v")))
    met = ranked.join(F.broadcast(listed), "bin").filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("k")))
    part = F.col("place") - F.floor("place")
    weight = F.when(F.col("index") == F.floor("place"), 1 - part).otherwise(part)
    return met.groupBy("rank").agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("value"))


def value_histogram(cube: RasterCube, low: float, high: float, bins: int, band: int | str = 0) -> DataFrame:
    """([t,] bin, n) of equal bins between low and high; values beyond go to the outer bins."""
    b = F.col(cube.band(band))
    at = F.least(F.greatest(F.floor((b - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return cube.df.filter(b.isNotNull()).groupBy(*(["t"] if cube.meta.has_time else []), at.alias("bin")).agg(F.count("*").alias("n"))


def line_cells(cube: RasterCube, lines: DataFrame) -> DataFrame:
    """The cube's rows once for each line feature (feature_index, line: array of x, y) that passes through the cell.

    A piece of a line is cut at the columns of cells, and in each column it passes the rows between both of its ends there.
    """
    m = cube.meta
    place = F.transform("line", lambda p: F.struct(((p["x"] - m.xmin) / m.cell_w).alias("x"), ((m.ymax - p["y"]) / m.cell_h).alias("y")))
    rows = lines.select("feature_index", place.alias("p"))
    ends = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(F.least(a["x"], b["x"]).alias("x0"), F.greatest(a["x"], b["x"]).alias("x1"), F.when(a["x"] <= b["x"], a["y"]).otherwise(b["y"]).alias("y0"), F.when(a["x"] <= b["x"], b["y"]).otherwise(a["y"]).alias("y1")))
    pieces = rows.select("feature_index", F.inline(ends)).withColumn("x", F.explode(F.sequence(F.floor("x0").cast("long"), F.floor("x1").cast("long"))))
    rise = F.when(F.col("x1") > F.col("x0"), (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    enter = F.when(F.col("x1") > F.col("x0"), F.col("y0") + rise * (F.greatest("x0", F.col("x").cast("double")) - F.col("x0"))).otherwise(F.col("y0"))
    leave = F.when(F.col("x1") > F.col("x0"), F.col("y0") + rise * (F.least("x1", F.col("x") + 1.0) - F.col("x0"))).otherwise(F.col("y1"))
    cells = pieces.withColumns({"__a": F.floor(F.least(enter, leave)).cast("long"), "__b": F.floor(F.greatest(enter, leave)).cast("long")})
    cells = cells.select("feature_index", "x", F.explode(F.sequence("__a", "__b")).alias("y")).distinct()
    return cube.df.join(cells, ["x", "y"]).select("feature_index", *cube.keys, *cube.bands)


def aggregate_lines(cube: RasterCube, lines: DataFrame, reducers: list[str]) -> DataFrame:
    """One row for each line (and date) that passes any cell: columns <band>_<reducer>."""
    groups = ["t", "feature_index"] if cube.meta.has_time else ["feature_index"]
    made = [zonal_reducer(r, F.col(b), F.struct("y", "x")).alias(f"{b}_{r}") for b in cube.bands for r in reducers]
    return line_cells(cube, lines).groupBy(*groups).agg(*made)


def touched(cube: RasterCube, features: DataFrame) -> DataFrame:
    """As cells_in, with the cells that a feature's edge passes besides those whose centres it holds (partial cells)."""
    edges = features.filter("rings is not null").select("feature_index", F.explode("rings").alias("r"))
    edges = edges.select("feature_index", F.concat("r", F.slice("r", 1, 1)).alias("line"))
    return cells_in(cube, features).unionByName(line_cells(cube, edges)).dropDuplicates(["feature_index", *cube.keys])
