"""RasterCube: a DataFrame of cells with its metadata. Missing cells are NULL or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.meta import CubeMeta


class RasterCube:
    """An immutable cube: df has the key columns x, y and, with time, t, and one column for each band."""

    def __init__(self, df: DataFrame, meta: CubeMeta):
        missing = [c for c in [*meta.keys, *meta.bands] if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are missing")
        self.df, self.meta = df.select(*meta.keys, *meta.bands), meta

    @property
    def keys(self) -> list[str]:
        return self.meta.keys

    @property
    def bands(self) -> tuple[str, ...]:
        return self.meta.bands

    def with_bands(self, columns: dict[str, Column]) -> RasterCube:
        """The cube with exactly these bands."""
        return RasterCube(self.df.select(*self.keys, *(c.alias(n) for n, c in columns.items())), self.meta.of(bands=tuple(columns), types=()))

    def on(self, df: DataFrame, **changes) -> RasterCube:
        return RasterCube(df, self.meta.of(**changes))

    def band(self, which: int | str) -> str:
        if isinstance(which, str):
            if which not in self.bands:
                raise ValueError(f"no band {which} in {self.bands}")
            return which
        if not 0 <= which < len(self.bands):
            raise IndexError(f"band {which} is out of range for {self.bands}")
        return self.bands[which]

    def persist(self, level=None) -> RasterCube:
        """The cube, held in memory and on disk once it is computed."""
        return RasterCube(self.df.persist(level) if level else self.df.persist(), self.meta)

    def unpersist(self) -> RasterCube:
        return RasterCube(self.df.unpersist(), self.meta)

    def rounded(self, digits: int = 6) -> DataFrame:
        """Rows with bands as rounded doubles."""
        return self.df.select(*self.keys, *(F.round(F.col(b).cast("double"), digits).alias(b) for b in self.bands))


def clean(column: Column) -> Column:
    """NaN as missing."""
    return F.when(~F.isnan(column), column)


def from_cells(df: DataFrame, bands: list[str], **meta) -> RasterCube:
    """A cube from rows; NaN cells become NULL."""
    kinds = dict(df.dtypes)
    cells = df.select(*[c for c in ("x", "y", "t") if c in df.columns], *((clean(F.col(b)) if kinds[b] in ("float", "double") else F.col(b)).alias(b) for b in bands))
    return RasterCube(cells, CubeMeta(tuple(bands), has_time="t" in df.columns, **meta))
