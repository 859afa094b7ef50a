"""Cell-wise operators on bands: callbacks, casts, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.meta import SPARK_TYPES, cell_union
from gridloom.plans.graph import compile_bands


def apply(cube: RasterCube, graph: dict, **parameters) -> RasterCube:
    """A callback on each band alone."""
    return cube.with_bands({b: compile_bands(graph, [F.col(b)], [b], **parameters)[0] for b in cube.bands})


def map_bands(cube: RasterCube, graph: dict, names: list[str] | None = None, **parameters) -> RasterCube:
    """A callback on the list of bands; its results are bands `names`, or the old names if as many, or b0, b1, ..."""
    made = compile_bands(graph, [F.col(b) for b in cube.bands], list(cube.bands), **parameters)
    names = names or (list(cube.bands) if len(made) == len(cube.bands) else [f"b{i}" for i in range(len(made))])
    if len(names) != len(made):
        raise ValueError(f"{len(made)} results for the names {names}")
    return cube.with_bands(dict(zip(names, made, strict=True)))


def convert(cube: RasterCube, cell_type: str, nodata: float | None = None) -> RasterCube:
    """Another cell type; cells equal to nodata become missing."""
    def cell(b: str):
        c = F.col(b) if nodata is None else F.nullif(F.col(b), F.lit(nodata))
        return c.try_cast(SPARK_TYPES[cell_type]).alias(b)

    return cube.on(cube.df.select(*cube.keys, *(cell(b) for b in cube.bands)), types=(cell_type,) * len(cube.bands))


def to_nodata(cube: RasterCube, value: float) -> RasterCube:
    """Missing cells as a sentinel, for sinks."""
    return cube.on(cube.df.fillna(value, list(cube.bands)))


def normalize(cube: RasterCube, old_min: float, old_max: float, new_min: float, new_max: float) -> RasterCube:
    scale = (new_max - new_min) / (old_max - old_min)
    return cube.with_bands({b: (F.col(b) - old_min) * scale + new_min for b in cube.bands})


#: boundary -> whether a value belongs to a break; breaks are tried from the smallest (or, for greater, the largest).
BOUNDARIES = {
    "LessThan": (lambda c, k: c < k, False),
    "LessThanOrEqualTo": (lambda c, k: c <= k, False),
    "GreaterThan": (lambda c, k: c > k, True),
    "GreaterThanOrEqualTo": (lambda c, k: c >= k, True),
    "Exact": (lambda c, k: c == k, False),
}


def reclassify(cube: RasterCube, breaks: dict[float, float], boundary: str = "LessThanOrEqualTo", nodata: float | None = None, fallback: float | None = None, strict: bool = False) -> RasterCube:
    """Values by class. Missing cells become nodata; values without class fallback, or an error with strict."""
    test, falling = BOUNDARIES[boundary]

    def cell(b: str):
        out = None
        for k in sorted(breaks, reverse=falling):
            hit = test(F.col(b), F.lit(k))
            out = F.when(hit, F.lit(breaks[k])) if out is None else out.when(hit, F.lit(breaks[k]))
        rest = F.raise_error(F.concat(F.lit("no class for "), F.col(b).cast("string"))).cast("double") if strict else F.lit(fallback)
        classed = out.otherwise(rest) if out is not None else rest
        return F.when(F.col(b).isNull(), F.lit(nodata)).otherwise(classed)

    return cube.with_bands({b: cell(b) for b in cube.bands})


def union_type(types: list[str]) -> str:
    out = types[0]
    for t in types[1:]:
        out = cell_union(out, t)
    return out
