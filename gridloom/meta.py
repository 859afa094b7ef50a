"""What a cube is besides its rows: grid, bands, cell types, tiles."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell types in the order of their width: bits, floating, signed.
CELL_TYPES = {
    "bool": (1, False, False), "int8": (8, False, True), "uint8": (8, False, False), "int16": (16, False, True), "uint16": (16, False, False),
    "int32": (32, False, True), "float32": (32, True, True), "float64": (64, True, True),
}
SPARK_TYPES = {"bool": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "float32": "float", "float64": "double"}


def cell_union(a: str, b: str) -> str:
    """The type that holds cells of both: the wider; of equal width the floating one; mixed signs widen."""
    if a == b:
        return a
    (bits_a, float_a, signed_a), (bits_b, float_b, signed_b) = CELL_TYPES[a], CELL_TYPES[b]
    if bits_a != bits_b:
        return a if bits_a > bits_b else b
    if float_a != float_b:
        return a if float_a else b
    if signed_a != signed_b:
        return "int16" if bits_a == 8 else "int32"
    return a


def constant_type(value: float | int) -> str:
    """Cell type of a numeric constant: the smallest integer that holds it, float32 up to 7 significant digits."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "uint8" if 0 <= value < 255 else "int16" if -(1 << 15) < value < 1 << 15 else "int32"
    digits = len(repr(value).lower().split("e")[0].replace("-", "").replace(".", "").strip("0"))
    return "float32" if digits <= 7 else "float64"


@dataclass(frozen=True)
class CubeMeta:
    """Grid of a cube. Columns x, y count cells from the upper left corner; row 0 is the northern edge."""

    bands: tuple[str, ...]
    has_time: bool = True
    xmin: float = 0.0
    ymax: float = 0.0
    cell_w: float = 1.0
    cell_h: float = 1.0
    tile_cols: int = 8
    tile_rows: int = 8
    crs: str = "grid"
    types: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return ["x", "y", "t"] if self.has_time else ["x", "y"]

    def of(self, **changes) -> CubeMeta:
        return replace(self, **changes)

    def type_of(self, band: str) -> str:
        return self.types[self.bands.index(band)] if self.types else "float64"

    def centre(self) -> tuple[Column, Column]:
        return self.xmin + (F.col("x") + 0.5) * self.cell_w, self.ymax - (F.col("y") + 0.5) * self.cell_h

    def cell_of(self, cx: Column, cy: Column) -> tuple[Column, Column]:
        """Cell indices of a coordinate; upper and left edges belong to a cell."""
        return F.floor((cx - self.xmin) / self.cell_w).cast("long"), F.floor((self.ymax - cy) / self.cell_h).cast("long")

    def tile_of(self) -> tuple[Column, Column]:
        return F.expr(f"cast(floor(x / {self.tile_cols}) as bigint)"), F.expr(f"cast(floor(y / {self.tile_rows}) as bigint)")

    def same_grid(self, other: CubeMeta) -> bool:
        return (self.xmin, self.ymax, self.cell_w, self.cell_h, self.crs) == (other.xmin, other.ymax, other.cell_w, other.cell_h, other.crs)


def utm_floating(xmin: float, ymax: float, resolution: float) -> tuple[float, float]:
    """The corner snapped to the resolution, so that cubes of one zone line up."""
    return (xmin // resolution) * resolution, -((-ymax) // resolution) * resolution


def tile_size(cols: int, rows: int, wanted: int | None = None) -> int:
    """Tile edge for a cube: tiny cubes one tile of 32, small polygons 128, else what is wanted or 256."""
    longest = max(cols, rows)
    return 32 if longest <= 1 else 128 if longest <= 128 and not wanted else wanted or 256
