from __future__ import annotations

from collections import defaultdict
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.operators import sensors
from gridloom.sources import derived

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_kernel_fft_over_several_tiles(spark):
    cells = {(r.x, r.y): r.v for r in derived.vectors_cube(spark, LARGE).df.collect()}
    cols, rows = max(x for x, _ in cells) + 1, max(y for _, y in cells) + 1
    assert rows > 2 * 256
    wide = np.zeros((rows + 12, cols + 12))
    for (x, y), v in cells.items():
        wide[y + 6, x + 6] = v or 0
    want = sum((1 + abs(dx) + dy * 0.5) * wide[6 + dy : 6 + dy + rows, 6 + dx : 6 + dx + cols] for dy in range(-6, 7) for dx in range(-6, 7))
    got = {(r.x, r.y): r.v for r in queries.QUERIES["kernel_fft_whole"](spark, LARGE).collect()}
    assert set(got) == set(cells)
    assert all(got[x, y] == pytest.approx(want[y, x], abs=2e-3) for x, y in got)


def test_closest_in_time_takes_every_row(spark):
    orders, lines = (derived.table(spark, SMALL, n).collect() for n in ("orders", "lineitem"))
    near = defaultdict(list)
    for r in lines:
        day = r.l_shipdate.date() if hasattr(r.l_shipdate, "date") else r.l_shipdate
        near[r.l_suppkey % 20].append((day, r.l_extendedprice))
    got = {r["product"]: r.price for r in queries.QUERIES["closest_in_time_whole"](spark, SMALL).collect()}
    assert len(got) == len(orders)
    for o in orders:
        t = o.o_orderdate.date() if hasattr(o.o_orderdate, "date") else o.o_orderdate
        found = [(abs((d - t).days), d, p) for d, p in near[o.o_custkey % 20] if abs((d - t).days) <= 10]
        assert got[o.o_orderkey] == (min(found)[2] if found else None)


def _joined(df) -> int:
    """Rows that the joins of a collected plan made."""
    def rows(node) -> int:
        metric = node.metrics().get("numOutputRows") if "Join" in node.nodeName() else None
        children = node.children()
        return (metric.get().value() if metric and metric.isDefined() else 0) + sum(rows(children.apply(i)) for i in range(children.size()))

    return rows(df._jdf.queryExecution().executedPlan())


def test_closest_in_time_makes_no_pairs(spark):
    day = F.lit("2024-01-01").cast("date")
    left = spark.range(1000).select(F.col("id").alias("product"), F.lit(1).alias("k"), (day + (F.col("id") % 2).cast("int")).alias("t"))
    right = spark.range(1000).select(F.lit(1).alias("k"), day.alias("t"), F.col("id").cast("double").alias("v"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sensors.closest_in_time(left, right, "k", "t", "t", "v", 10)
        assert {r.v for r in got.collect()} == {0.0}
        assert _joined(got) == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_closest_in_time_missing_values_and_ties(spark):
    at = lambda d: date(2024, 1, d) if d else None
    right = spark.createDataFrame([(1, at(10), None), (1, at(10), 7.0), (1, at(10), 5.0), (1, at(14), 3.0), (1, at(20), None), (2, at(20), None), (None, at(10), 1.0), (1, None, 0.0)], "k int, t date, v double")
    asked = [(1, 1, 10), (2, 1, 12), (3, 1, 13), (4, 1, 19), (5, 1, 20), (6, 1, 30), (7, 2, 20), (8, None, 10), (9, 1, None), (10, 3, 10)]
    left = spark.createDataFrame([(i, k, at(d)) for i, k, d in asked] + [(1, 1, at(10))], "product int, k int, t date")

    def prices(days: int) -> list[float | None]:
        return [r.v for r in sensors.closest_in_time(left, right, "k", "t", "t", "v", days).orderBy("product").collect()]

    assert prices(5) == [5.0, 5.0, 3.0, 3.0, None, None, None, None, None, None]
    assert prices(6) == [5.0, 5.0, 3.0, 3.0, 3.0, None, None, None, None, None]
    assert prices(0) == [5.0] + [None] * 9


def test_means_of_events_dont_depend_on_the_order(spark, tmp_path):
    """Forty copies of values whose mean is 38: doubles added in either order end beside it."""
    values = [77.67, 10.74, 2.16, 61.43]
    for name, held in (("up", values), ("down", values[::-1])):
        rows = [(i, datetime(2024, 1, 1), 17, "click", v, "") for i, v in enumerate(held * 40)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        (row,) = queries.QUERIES["apply_int"](spark, f"{tmp_path}/{name}").collect()
        assert (row.click, row.view) == (38, None)


def test_mean_of_any_doubles(spark):
    held = {"a": [1 / 3, 2 / 3, None], "b": [1e-9, 3e-9], "c": [1e300, 1e300], "d": [float("nan"), 1.0], "e": [float("inf"), 1.0], "f": [None], "g": [-0.25, 123456789012345.5]}
    df = spark.createDataFrame([(k, v) for k, vs in held.items() for v in vs], "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(derived.mean(F.col("v")).alias("m")).collect()}
    assert got["a"] == pytest.approx(0.5, rel=1e-15) and got["b"] == pytest.approx(2e-9, rel=1e-12) and got["c"] == 1e300
    assert np.isnan(got["d"]) and got["e"] == float("inf") and got["f"] is None and got["g"] == 61728394506172.625
