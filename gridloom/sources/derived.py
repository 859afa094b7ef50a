"""Cubes over the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.meta import CubeMeta

EVENT_BANDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean(v: Column) -> Column:
    """The mean of a double column whatever the order of its rows.

    Six decimals of the values are added as decimals, without rounding errors; only what is beyond them (or over 12 digits)
    is added as doubles. A plain sum of doubles ends beside a whole mean, on either side, as the rows happen to come.
    """
    part = v.try_cast("decimal(18,6)")
    rest = F.sum(v - F.coalesce(part.cast("double"), F.lit(0.0)))
    return (F.coalesce(F.sum(part).cast("double"), F.lit(0.0)) + rest) / F.nullif(F.count(v), F.lit(0))


def events_cube(spark: SparkSession, sf_dir: str) -> RasterCube:
    """x, y from the user, t the day; a band for each type of event: its mean value."""
    e = table(spark, sf_dir, "events")
    bands = [mean(F.when(F.col("event_type") == b, F.col("value"))).alias(b) for b in EVENT_BANDS]
    df = e.groupBy((F.col("user_id") % 16).alias("x"), F.expr("user_id div 16").alias("y"), F.col("ts").cast("date").alias("t")).agg(*bands)
    return RasterCube(df, CubeMeta(EVENT_BANDS))


def lineitem_cube(spark: SparkSession, sf_dir: str) -> RasterCube:
    """x from the supplier, y from the part, t the month of shipping; bands qty, price, disc, tax."""
    li = table(spark, sf_dir, "lineitem")
    bands = [F.sum("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax")]
    df = li.groupBy((F.col("l_suppkey") % 10).alias("x"), (F.col("l_partkey") % 10).alias("y"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("t")).agg(*bands)
    return RasterCube(df, CubeMeta(("qty", "price", "disc", "tax")))


def vectors_cube(spark: SparkSession, sf_dir: str) -> RasterCube:
    """Each vector of 64 numbers is a tile of 8 by 8 cells, 25 tiles to a row; v in thousandths."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    df = e.select((8 * (F.col("vec_id") % 25) + F.col("pos") % 8).alias("x"), (8 * F.expr("vec_id div 25") + F.expr("pos div 8")).alias("y"), F.floor(F.col("value").cast("double") * 1000).cast("double").alias("v"))
    return RasterCube(df, CubeMeta(("v",), has_time=False))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a catalogue of products."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("product"), F.col("o_orderdate").cast("date").alias("t"), (F.col("o_custkey") % 20).alias("tcol"), F.expr("(o_custkey div 20) % 20").alias("trow"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
