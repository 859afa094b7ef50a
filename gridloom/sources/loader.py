"""Cubes from products: which products serve which tiles, which of several wins, and the cells that result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.meta import CubeMeta


def on_tiles(products: DataFrame, meta: CubeMeta, wanted: DataFrame | None = None) -> DataFrame:
    """(product, t, tcol, trow, covers, distance): each product with each tile that its box touches.

    products: product, t, xmin, ymin, xmax, ymax. covers: the box holds the whole tile; distance: between both centres.
    wanted: tiles (tcol, trow) to keep. Tiles come from the box by arithmetic; nothing is paired.
    """
    wide, high = meta.cell_w * meta.tile_cols, meta.cell_h * meta.tile_rows

    def spans(low: Column, high_: Column) -> Column:
        """Tiles from the one that holds low to the one before high_."""
        first = F.floor(low).cast("long")
        return F.sequence(first, F.greatest(first, F.ceil(high_).cast("long") - 1))

    rows = products.withColumn("tcol", F.explode(spans((F.col("xmin") - meta.xmin) / wide, (F.col("xmax") - meta.xmin) / wide)))
    rows = rows.withColumn("trow", F.explode(spans((meta.ymax - F.col("ymax")) / high, (meta.ymax - F.col("ymin")) / high)))
    left, top = meta.xmin + F.col("tcol") * wide, meta.ymax - F.col("trow") * high
    covers = (F.col("xmin") <= left) & (F.col("xmax") >= left + wide) & (F.col("ymax") >= top) & (F.col("ymin") <= top - high)
    distance = F.hypot((F.col("xmin") + F.col("xmax")) / 2 - left - wide / 2, (F.col("ymin") + F.col("ymax")) / 2 - top + high / 2)
    out = rows.select("product", "t", "tcol", "trow", covers.alias("covers"), distance.alias("distance"))
    return out if wanted is None else out.join(wanted.select("tcol", "trow").distinct(), ["tcol", "trow"], "left_semi").select("product", "t", "tcol", "trow", "covers", "distance")


def resolve(pairs: DataFrame) -> DataFrame:
    """pairs with their rank for a tile and date, nearest first; those behind the first that covers the tile go, unless that
    one has gaps of its own, which only its cells can tell: so they go for tiles, not for cells."""
    near = W.partitionBy("t", "tcol", "trow").orderBy("distance", "product")
    before = F.max(F.col("covers").cast("int")).over(near.rowsBetween(W.unboundedPreceding, -1))
    ranked = pairs.withColumn("rank", F.row_number().over(near)).withColumn("__covered", F.coalesce(before, F.lit(0)))
    return ranked.filter(F.col("__covered") == 0).drop("__covered")


def load_products(cells: DataFrame, pairs: DataFrame, meta: CubeMeta) -> RasterCube:
    """A cube from the cells (product, x, y, bands) of products: band by band the first valid value in the order of ranks.

    pairs: product, t, tcol, trow, rank. Cells meet their pair by product and tile, then one aggregation by cell follows.
    """
    tx, ty = meta.tile_of()
    met = cells.withColumns({"tcol": tx, "trow": ty}).join(pairs.select("product", "t", "tcol", "trow", "rank"), ["product", "tcol", "trow"])
    picked = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("rank"))).alias(b) for b in meta.bands]
    return RasterCube(met.groupBy("x", "y", "t").agg(*picked), meta.of(has_time=True))


def too_cloudy(products: DataFrame, clouds: DataFrame, limit: float) -> DataFrame:
    """Dates and tiles (t, tcol, trow) that clouds (product, share) leave out: no product of them, or all above the limit.

    Both sides count: products without a cloud share are clear, shares without a product are nothing.
    """
    both = products.join(clouds, "product", "full_outer").filter("tcol is not null")
    share = F.min(F.coalesce("share", F.lit(0.0)))
    return both.groupBy("t", "tcol", "trow").agg(share.alias("share")).filter(F.col("share") > limit).select("t", "tcol", "trow")
