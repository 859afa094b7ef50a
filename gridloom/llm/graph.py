"""Connected components by alternating large and small stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import folder, remove


def _written(edges: DataFrame) -> tuple[str, DataFrame, tuple]:
    """(folder, edges as written there, their number and digest).

    The digest reads the written table. It isn't observed while writing: a session that has observed anything can no
    longer send out closures that hold it, as those of fitted models do.
    """
    spark = edges.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    edges.write.parquet(path)
    now = spark.read.schema(edges.schema).parquet(path)
    return path, now, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Self loops are dropped; an empty table of edges gives an empty result. Each round is written to the shared folder, so
    a lost executor costs one round at most; the table of the round before goes. The rounds end when the edges no longer
    change.
    """
    path, now, before = _written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while before[0]:
        after_path, now, after = _written(_small_star(_large_star(now)))
        remove(now.sparkSession, path)
        path = after_path
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
