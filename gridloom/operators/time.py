"""Operators along time."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.functions import series
from gridloom.operators.zonal import small
from gridloom.plans.graph import compile_series, single


def _aggregates(cube: RasterCube, graph: dict | str, names: list[str] | None = None) -> tuple[list[Column], list[str]]:
    graph = single(graph) if isinstance(graph, str) else graph
    columns, bands = [], []
    for b in cube.bands:
        made = compile_series(graph, F.col(b), F.col("t"))
        if names is None and len(made) > 1:
            raise ValueError("a reducer gives one value for each band")
        for i, c in enumerate(made):
            bands.append(f"{b}_{names[i]}" if names else b)
            columns.append(c.alias(bands[-1]))
    return columns, bands


def reduce_time(cube: RasterCube, graph: dict | str) -> RasterCube:
    """One value for each cell and band; partial aggregation runs before the shuffle."""
    columns, bands = _aggregates(cube, graph)
    return cube.on(cube.df.groupBy("x", "y").agg(*columns), has_time=False, bands=tuple(bands), types=())


def time_to_bands(cube: RasterCube, graph: dict, names: list[str]) -> RasterCube:
    """Time collapsed; several results for each band become bands `<band>_<name>`."""
    columns, bands = _aggregates(cube, graph, names)
    return cube.on(cube.df.groupBy("x", "y").agg(*columns), has_time=False, bands=tuple(bands), types=())


def apply_time(cube: RasterCube, function) -> RasterCube:
    """function(band column, window) -> column, over each cell's series; labels stay."""
    w = W.partitionBy("x", "y").orderBy("t")
    return cube.with_bands({b: function(F.col(b), w) for b in cube.bands})


def interpolate_linear(cube: RasterCube, by_time: bool = False) -> RasterCube:
    """Interior gaps from both neighbours, by the distance of positions or, with by_time, of days; ends stay missing."""
    w = W.partitionBy("x", "y").orderBy("t")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    # Days as numbers in one scale; positions are taken within the cell.
    df = cube.df.withColumn("__n", F.datediff("t", F.lit(date(1970, 1, 1))) if by_time else F.row_number().over(w))

    def filled(b: str) -> Column:
        at = F.when(F.col(b).isNotNull(), F.col("__n"))
        low, high = F.last(b, True).over(back), F.first(b, True).over(ahead)
        n0, n1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
        return F.coalesce(F.col(b), low + (high - low) * (F.col("__n") - n0) / (n1 - n0))

    return cube.on(df.select(*cube.keys, *(filled(b).alias(b) for b in cube.bands)))


def intervals(spark: SparkSession, spans: list[tuple[str, str]], labels: list[str] | None = None) -> DataFrame:
    """Half-open spans with labels (their starts by default); a listed, small table."""
    rows = [(datetime.fromisoformat(a).date(), datetime.fromisoformat(b).date(), datetime.fromisoformat(c).date()) for (a, b), c in zip(spans, labels or [a for a, _ in spans], strict=True)]
    return spark.createDataFrame(rows, "__start date, __end date, label date")


def in_intervals(cube: RasterCube, spans: DataFrame) -> DataFrame:
    """Rows once for each span that holds them, with its label; spans may overlap.

    A span becomes the dates of the cube that it holds, so that rows meet spans by equal dates.
    """
    dates = spans.withColumn("t", F.explode(F.sequence("__start", F.date_sub("__end", 1)))).filter("__start < __end").select("t", "label")
    return cube.df.join(small(dates), "t").select(*cube.keys, *cube.bands, "label")


def aggregate_temporal(cube: RasterCube, spans: DataFrame, graph: dict | str, dense: bool = True) -> RasterCube:
    """One value for each cell, band and span; dense: cells without values in a span are there with missing bands."""
    columns, bands = _aggregates(cube, graph)
    found = in_intervals(cube, spans).groupBy("x", "y", "label").agg(*columns)
    if dense:
        # The labels are listed; each cell is repeated for each of them, nothing is paired.
        grid = cube.df.select("x", "y").distinct().join(small(spans.select("label").distinct()))
        found = found.join(grid, ["x", "y", "label"], "right")
    return cube.on(found.withColumnRenamed("label", "t"), bands=tuple(bands), types=())


def instant_to_interval(cube: RasterCube, spans: DataFrame) -> RasterCube:
    """Rows under the labels of their spans; rows without a span go."""
    return cube.on(in_intervals(cube, spans).drop("t").withColumnRenamed("label", "t"))


def apply_in_intervals(cube: RasterCube, spans: DataFrame, function) -> DataFrame:
    """function(band column, window) over each cell's series in each span; rows keep their dates: label, x, y, t, bands."""
    w = W.partitionBy("x", "y", "label").orderBy("t")
    return in_intervals(cube, spans).select("label", *cube.keys, *(function(F.col(b), w).alias(b) for b in cube.bands))


def day_spans(first: str, days: int, count: int, overlap: int = 0) -> list[tuple[str, str]]:
    start = date.fromisoformat(first).toordinal()
    return [(date.fromordinal(start + i * days).isoformat(), date.fromordinal(start + (i + 1) * days + overlap).isoformat()) for i in range(count)]


def quantile_bands(cube: RasterCube, probabilities: list[float]) -> RasterCube:
    return time_to_bands(cube, single("quantiles", probabilities=probabilities), [f"q{round(p * 100)}" for p in probabilities])


def running(name: str):
    """Running reducers for apply_time."""
    return lambda c, w: {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "count": F.count}[name](c).over(w.rowsBetween(W.unboundedPreceding, 0))


REDUCERS = tuple(series.REDUCERS)
