"""User functions over cubes, in Arrow batches of one group each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.ship import ship


class CubeArray:
    """What a user function gets and returns: values (t, bands, y, x) or (bands, y, x), NaN where missing."""

    def __init__(self, values: np.ndarray, bands: list[str], times: list | None = None):
        self.values, self.bands, self.times = values, list(bands), times


def _check(made: CubeArray, rows: int, cols: int, keep_times: bool) -> CubeArray:
    values = np.asarray(made.values)
    if not np.issubdtype(values.dtype, np.floating):
        raise TypeError(f"a user function returns floating cells, not {values.dtype}")
    if values.ndim == 2:
        values, made = values[None], CubeArray(values[None], made.bands[:1], made.times)
    if values.shape[-2:] != (rows, cols):
        raise ValueError(f"cells {values.shape[-2:]} instead of {(rows, cols)}: the size of tiles stays")
    if len(made.bands) != values.shape[-3]:
        raise ValueError(f"{values.shape[-3]} bands for the names {made.bands}")
    if keep_times and values.ndim == 4 and (made.times is None or len(made.times) != values.shape[0]):
        raise ValueError("as many dates as slices are needed")
    return CubeArray(values, made.bands, made.times)


def _wrap(function: Callable, bands: tuple[str, ...], out: list[str], group: str | None, in_time: bool, context: dict) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        xs, ys = rows["x"].to_numpy(), rows["y"].to_numpy()
        x0, y0 = int(xs.min()), int(ys.min())
        cols, lines = int(xs.max()) - x0 + 1, int(ys.max()) - y0 + 1
        times, ti = [None], 0
        if "t" in rows:
            times = sorted(rows["t"].unique())
            ti = rows["t"].map({t: i for i, t in enumerate(times)}).to_numpy()
        values = np.full((len(times), len(bands), lines, cols), np.nan, dtype=np.float32)
        for i, b in enumerate(bands):
            values[ti, i, ys - y0, xs - x0] = rows[b].to_numpy(dtype=float)
        made = _check(function(CubeArray(values if in_time else values[0], list(bands), times if in_time else None), context), lines, cols, in_time)
        if list(made.bands) != out:
            raise ValueError(f"bands {made.bands} instead of {out}")
        slices = made.values if made.values.ndim == 4 else made.values[None]
        labels = made.times if in_time and made.values.ndim == 4 else times
        frames = []  # NaN becomes NULL on the way back
        for t, cells in zip(labels, slices, strict=True):
            yy, xx = np.nonzero(~np.isnan(cells).all(axis=0))
            frame = {"x": xx + x0, "y": yy + y0} | ({"t": t} if "t" in rows else {})
            frame |= {b: cells[i, yy, xx].astype(float) for i, b in enumerate(out)}
            frames.append(pd.DataFrame(frame))
        done = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if group:
            done[group] = rows[group].iloc[0]
        return done

    return run


def _schema(df: DataFrame, out: list[str], has_time: bool, group: str | None) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"x {kinds['x']}", f"y {kinds['y']}", *([f"t {kinds['t']}"] if has_time else []), *(f"`{b}` double" for b in out), *([f"{group} {kinds[group]}"] if group else [])])


def _tiled(cube: RasterCube) -> DataFrame:
    tx, ty = cube.meta.tile_of()
    return cube.df.withColumns({"__tx": tx, "__ty": ty})


def run_on_tiles(cube: RasterCube, function: Callable, bands: list[str] | None = None, context: dict | None = None) -> RasterCube:
    """function(CubeArray (bands, y, x), context) on each tile and date alone; it may add and drop bands."""
    ship(cube.df.sparkSession)
    out = list(bands or cube.bands)
    df = _tiled(cube)
    groups = ["__tx", "__ty", *(["t"] if cube.meta.has_time else [])]
    done = df.groupBy(*groups).applyInPandas(_wrap(function, cube.bands, out, None, False, context or {}), _schema(df, out, cube.meta.has_time, None))
    return cube.on(done, bands=tuple(out), types=())


def run_on_series(cube: RasterCube, function: Callable, bands: list[str] | None = None, context: dict | None = None) -> RasterCube:
    """function(CubeArray (t, bands, y, x), context) on each tile's whole series; it may change dates and bands."""
    ship(cube.df.sparkSession)
    out, df = list(bands or cube.bands), _tiled(cube)
    done = df.groupBy("__tx", "__ty").applyInPandas(_wrap(function, cube.bands, out, None, True, context or {}), _schema(df, out, True, None))
    return cube.on(done, bands=tuple(out), types=())


def run_on_features(cube: RasterCube, grouped: DataFrame, function: Callable, bands: list[str] | None = None, context: dict | None = None) -> DataFrame:
    """function on each feature's cells (rows of group_by_feature); rows with feature_index come back."""
    ship(cube.df.sparkSession)
    out = list(bands or cube.bands)
    return grouped.groupBy("feature_index").applyInPandas(_wrap(function, cube.bands, out, "feature_index", cube.meta.has_time, context or {}), _schema(grouped, out, cube.meta.has_time, "feature_index"))


def with_metadata(cube: RasterCube, apply_metadata: Callable | None) -> RasterCube:
    """apply_metadata(meta, context) -> meta names the bands and cell sizes that a function's result has, before it runs."""
    return cube if apply_metadata is None else RasterCube(cube.df, apply_metadata(cube.meta, {}))


def predict(cube: RasterCube, model, names: list[str] | None = None, probabilities: bool = False) -> RasterCube:
    """A forest of pyspark.ml over the bands: a class, or one band for each class's probability.

    A cell with a missing band has a missing result. The model must take as many features as there are bands.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if model.numFeatures > len(cube.bands):
        raise ValueError(f"the model needs {model.numFeatures} features, the cube has {len(cube.bands)} bands")
    used = list(cube.bands[: model.numFeatures])
    # Missing bands go through the model as zeros and their results are taken back, so the cube is computed once.
    known = reduce(lambda a, b: a & b, (F.col(b).isNotNull() for b in used))
    filled = cube.df.withColumn("__known", known).withColumns({f"__{b}": F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in used})
    done = model.transform(VectorAssembler(inputCols=[f"__{b}" for b in used], outputCol="features").transform(filled))
    if probabilities:
        names = names or [f"p{i}" for i in range(model.numClasses)]
        made = [F.when(F.col("__known"), vector_to_array("probability")[i]).alias(n) for i, n in enumerate(names)]
    else:
        names = names or ["prediction"]
        made = [F.when(F.col("__known"), F.col("prediction")).alias(names[0])]
    return cube.on(done.select(*cube.keys, *made), bands=tuple(names), types=())
