from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import topk


def brute(rows, k=5, every=7):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=5, every=7):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % every == 0, k).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "TOGETHER", 9)
    monkeypatch.setattr(topk, "WAVE", 30)
    monkeypatch.setattr(topk, "BATCHES", (3, 7))
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[4][1]) for i in range(150)]  # ties
    rows += [(800, None), (801, [None] * 16), (802, [float("nan")] * 16), (803, [float("inf")] * 16), (804, []), (805, [1.0] * 3), (806, [0.0] * 16), (None, rows[0][1]), (807, [-3.0] * 20)]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (7, [-1.0])]) == [(0, 1, 7, -65536), (7, 1, 0, -65536)]


def test_bounds_prune(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 32)) * 2
    near = [(i, (centres[i % 12] + rng.normal(0, 0.05, 32)).tolist()) for i in range(6000)]
    even = [(i, (rng.normal(0, 1, 32)).tolist()) for i in range(6000)]
    got = []
    for rows in (near, even):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got.append(topk.report(df, F.col("vec_id") % 50 == 0).first())
        assert got[-1].pairs == 120 * 6000 and got[-1].by_block + got[-1].by_order + got[-1].scored == got[-1].pairs
    assert got[0].scored < 0.2 * got[0].pairs and got[0].by_block > 0.3 * got[0].pairs and got[0].by_order > 0
    assert got[1].scored > 0.5 * got[1].pairs  # nothing to prune where all directions are alike


def test_extra_columns_with_the_names_used_inside(spark):
    rows = [(i, [float(i % 5), 1.0], 7, 7, 7, 7, True) for i in range(20)]
    names = "vec_id long, embedding array<double>, near int, gap int, block int, score int, asks boolean"
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, names), F.col("vec_id") % 7 == 0, 3).collect())
    assert got == brute([r[:2] for r in rows], 3)
