from __future__ import annotations

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.cube import RasterCube, from_cells
from gridloom.functions import scalar
from gridloom.meta import CubeMeta
from gridloom.operators import focal, grid, local, mask, merge, sensors, time, udf, vector, zonal
from gridloom.plans.graph import single
from gridloom.sources import readers, sinks
from gridloom.streaming import events

D = [date(2017, 1, 1), date(2017, 1, 5), date(2017, 1, 15), date(2017, 2, 5)]


def cube(spark, cells, bands=("v",), has_time=True, **meta):
    schema = "x long, y long, " + ("t date, " if has_time else "") + ", ".join(f"{b} double" for b in bands)
    return RasterCube(spark.createDataFrame([tuple(float(v) if i >= (3 if has_time else 2) and v is not None else v for i, v in enumerate(r)) for r in cells], schema), CubeMeta(tuple(bands), has_time, **meta))


def flat(spark, rows, **meta):
    return cube(spark, [(x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)], has_time=False, **meta)


def cells(c):
    return {tuple(r[k] for k in c.keys): tuple(r[b] for b in c.bands) if len(c.bands) > 1 else r[c.bands[0]] for r in c.df.collect()}


def test_interval_mapping(spark):
    c = cube(spark, [(0, 0, d, i) for i, d in enumerate(D)])
    spans = time.intervals(spark, [("2017-01-01", "2017-01-15"), ("2017-01-15", "2017-02-01")])
    got = sorted((r.t, r.v) for r in time.instant_to_interval(c, spans).df.collect())
    assert got == [(D[0], 0), (D[0], 1), (D[2], 2)]


def test_aggregate_temporal_is_dense(spark):
    c = cube(spark, [(0, 0, D[0], -10), (0, 0, D[2], 4), (1, 0, D[1], 5), (1, 0, D[2], None)])
    spans = time.intervals(spark, [("2017-01-01", "2017-01-15"), ("2017-01-15", "2017-02-01"), ("2017-03-01", "2017-04-01")])
    got = cells(time.aggregate_temporal(c, spans, "median"))
    assert got == {(0, 0, D[0]): -10, (0, 0, D[2]): 4, (1, 0, D[0]): 5, (1, 0, D[2]): None, (0, 0, date(2017, 3, 1)): None, (1, 0, date(2017, 3, 1)): None}


def test_interpolation_by_time(spark):
    c = cube(spark, [(0, 0, D[0], 0), (0, 0, D[1], None), (0, 0, D[2], 14), (0, 0, D[3], None)])
    assert cells(time.interpolate_linear(c))[(0, 0, D[1])] == 7
    got = cells(time.interpolate_linear(c, by_time=True))
    assert got[(0, 0, D[1])] == 4 and got[(0, 0, D[3])] is None


def test_mask(spark):
    c = flat(spark, [[1, None, 3, 4]])
    m = cube(spark, [(0, 0, 0), (1, 0, 1), (2, 0, 1)], has_time=False)
    assert cells(mask.raster_mask(c, m, 10.0)) == {(0, 0): 1, (1, 0): None, (2, 0): 10, (3, 0): 4}
    missing = cube(spark, [(0, 0, None)], has_time=False)
    assert cells(mask.raster_mask(c, missing))[(0, 0)] is None
    timed = cube(spark, [(0, 0, D[0], 1), (3, 0, D[0], 2)])
    assert set(cells(mask.raster_mask(timed, m))) == {(0, 0, D[0])}
    with pytest.raises(ValueError):
        mask.raster_mask(c, cube(spark, [(0, 0, 1, 1)], ("a", "b"), False))


def test_merge(spark):
    a = cube(spark, [(0, 0, D[0], 2, 3), (0, 0, D[1], 2, 3)], ("a", "b"))
    b = cube(spark, [(0, 0, D[1], 5, 5, 5), (0, 0, D[2], 5, 5, 5)], ("a", "c", "d"))
    got = merge.merge_cubes(a, b)
    assert got.bands == ("a", "b", "a_2", "c", "d")
    assert cells(got) == {(0, 0, D[0]): (2, 3, None, None, None), (0, 0, D[1]): (2, 3, 5, 5, 5), (0, 0, D[2]): (None, None, 5, 5, 5)}
    z = flat(spark, [[1, None]])
    assert cells(merge.merge_cubes(z, z, "sum")) == {(0, 0): 2, (1, 0): None}
    assert cells(merge.merge_cubes(z, flat(spark, [[4, 7]]), "max")) == {(0, 0): 4, (1, 0): 7}
    with pytest.raises(NotImplementedError):
        merge.merge_cubes(z, z, "nothing")
    with pytest.raises(ValueError):
        merge.merge_cubes(a, b, "sum")
    with pytest.raises(ValueError):
        merge.merge_cubes(z, flat(spark, [[1]], cell_w=2.0))
    none = RasterCube(z.df.select("x", "y"), CubeMeta((), False))
    assert cells(merge.merge_cubes(cube(spark, [(0, 0, D[0], 9)]), none, "sum")) == {(0, 0, D[0]): 9}


def test_bit_operators(spark):
    a, b = flat(spark, [[1, 1, 0]]), flat(spark, [[1, 0, None]])
    assert list(cells(merge.merge_cubes(a, b, "and")).values()) == [1, 0, None]
    assert list(cells(merge.merge_cubes(a, b, "xor")).values()) == [0, 1, None]


def test_zonal_constant(spark):
    c = cube(spark, [(x, y, d, 10 if d == D[0] else None) for x in range(4) for y in range(4) for d in D[:2]])
    zones = zonal.polygons(spark, [[(0, 0), (4, 0), (4, -4), (0, -4)], [(1, -1), (3, -1), (3, -3), (1, -3)], [(50, 50), (60, 50), (60, 60)]])
    got = {(r.t, r.feature_index): (r.v_mean, r.v_sd) for r in zonal.aggregate_spatial(c, zones, ["mean", "sd"]).collect()}
    assert got == {(D[0], 0): (10, 0), (D[0], 1): (10, 0), (D[0], 2): (None, None), (D[1], 0): (None, None), (D[1], 1): (None, None), (D[1], 2): (None, None)}
    counts = {(r.t, r.feature_index): (r.v_count, r.v_count_all) for r in zonal.aggregate_spatial(c, zones, ["count", "count_all"]).collect()}
    assert counts[(D[0], 0)] == (16, 16) and counts[(D[1], 1)] == (0, 4) and counts[(D[1], 2)] == (0, 0)


def test_polygon_against_numpy(spark):
    ring = [(1.3, -0.4), (9.1, -3.2), (6.0, -8.8), (4.5, -4.0), (0.2, -7.5)]
    c = flat(spark, [[1] * 10] * 10)
    got = {(r.x, r.y) for r in zonal.cells_in(c, zonal.polygons(spark, [ring])).collect()}

    def inside(px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    assert got == {(x, y) for x in range(10) for y in range(10) if inside(x + 0.5, -(y + 0.5))}


def test_wkt(spark):
    assert vector.parse_wkt("POLYGON ((0 0, 4 0, 4 -4, 0 0))")[0][1] == (4, 0)
    assert len(vector.parse_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")) == 2
    assert zonal.cells_in(flat(spark, [[1, 2], [3, 4]]), vector.features_of_wkt(spark, ["POLYGON ((0 0, 2 0, 2 -1, 0 -1))"])).count() == 2


def test_rings_of_features(spark):
    c = flat(spark, [[1] * 12] * 12)
    hole = "POLYGON ((1 -1, 11 -1, 11 -11, 1 -11, 1 -1), (3 -3, 9 -3, 9 -9, 3 -9, 3 -3))"
    assert zonal.cells_in(c, vector.features_of_wkt(spark, [hole])).count() == 64
    parts = [[[[0, 0], [2, 0], [2, -2], [0, -2], [0, 0]]], [[[5, -5], [9, -5], [9, -9], [5, -9], [5, -5]], [[6, -6], [8, -6], [8, -8], [6, -8], [6, -6]]]]
    feature = {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": parts}}
    text = spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": [feature]}),)], "value string")
    got = vector.read_geojson(text)
    assert tuple(got.first()[1:5]) == (0, -9, 9, 0) and zonal.cells_in(c, got).count() == 4 + 12
    nothing = spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": None}]}),)], "value string")
    with pytest.raises(Exception, match="no polygon in feature 0"):
        vector.read_geojson(nothing).collect()
    moved = vector.reproject_features(vector.reproject_features(vector.features_of_wkt(spark, [hole]), "EPSG:4326", "EPSG:32631"), "EPSG:32631", "EPSG:4326")
    assert tuple(moved.first()[1:5]) == pytest.approx((1, -11, 11, -1), abs=1e-6)


def test_binary_geometries(spark):
    import struct

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, -4.0), (0.0, 0.0)]
    polygon = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    assert vector.parse_wkb(polygon) == [ring]
    assert vector.parse_wkb(struct.pack(">BII", 0, 6, 1) + polygon) == [ring]
    body = struct.pack("<I4d2I", 5, 0, -4, 4, 0, 1, 4) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = struct.pack(">I", 9994) + b"\0" * 96 + struct.pack(">2I", 1, len(body) // 2) + body
    assert vector.read_shapes(shp) == [[ring]]


def test_lines(spark):
    c = flat(spark, [[x + 10 * y for x in range(6)] for y in range(6)])
    lines = vector.lines_of_wkt(spark, ["LINESTRING (0.5 -0.5, 3.5 -0.5)", "LINESTRING (0.5 -0.5, 2.5 -4.5)", "LINESTRING (1.5 -0.5, 1.5 -2.5)"])
    got = {}
    for r in zonal.line_cells(c, lines).collect():
        got.setdefault(r.feature_index, set()).add((r.x, r.y))
    assert got[0] == {(0, 0), (1, 0), (2, 0), (3, 0)} and got[2] == {(1, 0), (1, 1), (1, 2)}
    assert got[1] == {(0, 0), (0, 1), (1, 1), (1, 2), (1, 3), (2, 3), (2, 4)}
    assert {r.feature_index: r.v_max for r in zonal.aggregate_lines(c, lines, ["max"]).collect()} == {0: 3, 1: 42, 2: 21}
    small = zonal.polygons(spark, [[(1.2, -1.2), (2.4, -1.2), (2.4, -2.3), (1.2, -2.3)]])
    assert {(r.x, r.y) for r in zonal.touched(c, small).collect()} == {(1, 1), (2, 1), (1, 2), (2, 2)}


def test_intersecting_features(spark):
    a = zonal.polygons(spark, [[(0, 0), (4, 0), (4, 4), (0, 4)], [(10, 10), (11, 10), (11, 11)]])
    b = zonal.polygons(spark, [[(1, 1), (2, 1), (2, 2)], [(3, 3), (8, 3), (8, 8)], [(4.5, 0), (6, 0), (6, 2)], [(9, 9), (20, 9), (20, 20), (9, 20)]])
    assert sorted(map(tuple, vector.intersecting(a, b, 3.0).collect())) == [(0, 0), (0, 1), (1, 3)]


def test_distance_by_blocks(spark):
    rng = np.random.default_rng(4)
    c = flat(spark, [[0] * 40 for _ in range(30)])
    for at in (rng.uniform(0, 1, (5, 2)) * [40, -30], np.array([[300.0, -5.0]]), rng.uniform(0, 1, (60, 2)) * [40, -30]):
        points = spark.createDataFrame([tuple(map(float, p)) for p in at], "px double, py double")
        got = cells(vector.euclidean_distance(c, points, block=4))
        assert len(got) == 1200
        for x, y in ((0, 0), (39, 29), (17, 3), (5, 22)):
            assert got[(x, y)] == pytest.approx(np.hypot(at[:, 0] - x - 0.5, at[:, 1] + y + 0.5).min())
    assert set(cells(vector.euclidean_distance(c, points.limit(0))).values()) == {None}


def test_vector_cube(spark):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, -1.0], [0.0, -1.0], [0.0, 0.0]]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": "a", "properties": {"pop": 3.0, "2021-01-05T00:00:00Z~b1": 7.0, "2021-01-05T00:00:00Z~b2": None}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]})
    features = vector.read_geojson(spark.createDataFrame([(text,)], "value string"))
    c = flat(spark, [[1, 2], [3, 4]])
    got = {(r.x, r.y, str(r.t), r.band, r.value) for r in vector.vector_to_raster(features, c.df, c.meta).collect()}
    assert got == {(x, 0, t, b, v) for x in (0, 1) for t, b, v in (("None", "pop", 3.0), ("2021-01-05 00:00:00", "b1", 7.0), ("2021-01-05 00:00:00", "b2", None))}


def test_regions(spark):
    rows = [[1, 1, 2, 1], [2, 1, 2, 1], [2, 2, 2, 1], [1, 1, 1, 1]]
    got = vector.vectorize(flat(spark, rows)).collect()
    assert sorted((r.value, r.cells, r.edges) for r in got) == [(1, 3, 8), (1, 7, 16), (2, 6, 14)]
    for r in vector.to_geojson(vector.vectorize(flat(spark, rows))).collect():
        f = json.loads(r.feature)
        area = sum((a[0] * b[1] - b[0] * a[1]) / 2 for ring in f["geometry"]["coordinates"] for a, b in zip(ring, ring[1:], strict=False))
        assert area == f["properties"]["cells"] and all(ring[0] == ring[-1] for ring in f["geometry"]["coordinates"])
    hole = [[1, 1, 1, 1], [1, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 1]]
    made = {r.value: r.rings for r in vector.with_rings(vector.vectorize(flat(spark, hole))).filter("value = 1").collect()}
    assert made[1][0] == [[0, -4], [4, -4], [4, 0], [0, 0], [0, -4]] or sorted(made[1][0][:-1]) == [[0, -4], [0, 0], [4, -4], [4, 0]]
    assert len(made[1]) in (2, 3)
    spiral = [[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]]
    assert sorted(r.cells for r in vector.vectorize(flat(spark, spiral)).collect()) == [8, 17]


def test_cost_distance(spark):
    c = flat(spark, [[1, 1, 1], [1, 9, 1], [1, 1, 1]])
    at = spark.createDataFrame([(0.5, -0.5)], "px double, py double")
    got = cells(vector.cost_distance(c, at, 100.0))
    want = {(0, 0): 0, (1, 0): 1, (2, 0): 2, (0, 1): 1, (1, 1): 6, (2, 1): 1 + 2**0.5, (0, 2): 2, (1, 2): 1 + 2**0.5, (2, 2): 2 + 2**0.5}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert set(cells(vector.cost_distance(c, at, 1.0))) == {(0, 0), (1, 0), (0, 1)}


def test_fft_is_the_direct_kernel(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-5, 9, (12, 9)).astype(float)
    c = flat(spark, values.tolist())
    for shape in ((3, 3), (4, 5), (2, 2)):
        kernel = rng.integers(-3, 4, shape).astype(float).tolist()
        direct, fourier = cells(focal.apply_kernel(c, kernel)), cells(focal.convolve_fft(c, kernel, tile=5))
        assert fourier == {k: pytest.approx(v if v is not None else 0, abs=1e-6) for k, v in direct.items()}


def test_neighbourhoods():
    assert len(focal.square(2)) == 25 and len(focal.circle(2)) == 13 and len(focal.nesw(1)) == 5 and len(focal.annulus(1, 1.5)) == 8
    assert {o[:2] for o in focal.wedge(1, 315, 45)} == {(0, 0), (1, 0)}


def test_slope_of_a_plane(spark):
    c = flat(spark, [[x + 2 * y for x in range(5)] for y in range(5)])
    assert cells(focal.slope(c))[(2, 2)] == pytest.approx(np.degrees(np.arctan(5**0.5)))
    east = flat(spark, [[-x for x in range(3)] for _ in range(3)])
    assert cells(focal.aspect(east))[(1, 1)] == pytest.approx(90)
    assert cells(focal.hillshade(flat(spark, [[5] * 3] * 3)))[(1, 1)] == 90
    assert cells(focal.tobler(flat(spark, [[0]])))[(0, 0)] == pytest.approx(6 * np.exp(-3.5 * 0.05))


def test_equal_sides_leave_no_slope(spark):
    level = flat(spark, [[273, -119, -25], [-59, 0, -64], [-276, 127, 32]])
    assert cells(focal.aspect(level, z_factor=0.01))[(1, 1)] is None
    assert cells(focal.slope(level, z_factor=0.01))[(1, 1)] == 0
    south = flat(spark, [[-110, 3, -85], [40, 212, 132], [219, -106, 10]])
    assert cells(focal.aspect(south, z_factor=0.01))[(1, 1)] == 0


def test_dilation(spark):
    rows = [[4] * 11 for _ in range(11)]
    rows[5][5] = 9
    got = cells(focal.dilation_mask(flat(spark, rows), 0, kernel1=0, kernel2=5, tile=4))
    masked = {k for k, v in got.items() if v}
    assert (5, 5) in masked and (5, 6) in masked and (0, 0) not in masked
    assert masked == {(10 - x, 10 - y) for x, y in masked} == {(y, x) for x, y in masked}
    assert not any(cells(focal.dilation_mask(flat(spark, rows), 3, mask1=(4, 9), kernel1=0, kernel2=5)).values())


def test_sharpen_prefers_alike_neighbours(spark):
    c = cube(spark, [(x, y, 1000 if x < 3 else 5000, 10 if x < 3 else 50) for x in range(6) for y in range(6)], ("fine", "coarse"), False)
    got = cells(focal.sharpen(c, ["fine"], ["coarse"]))
    assert got[(2, 3)] == pytest.approx(10) and got[(3, 3)] == pytest.approx(50)


def test_retile_and_pyramid(spark):
    c = flat(spark, [[x + 10 * y for x in range(6)] for y in range(4)])
    tiled = grid.retile(c, 4, 4, 1, 1)
    assert tiled.filter("tcol = 0 and trow = 0").count() == 20
    assert grid.remove_overlap(tiled, 4, 4, 1, 1).count() == 24
    assert cells(grid.pyramid(c, 1)[0])[(1, 1)] == np.mean([22, 23, 32, 33])
    square = grid.grid_square(F.lit(448251.0), F.lit(5411932.0), F.lit(31), F.lit(True))
    assert spark.range(1).select(square).first()[0] == "31UDQ"
    south = grid.grid_square(F.lit(334873.0), F.lit(6252266.0), F.lit(56), F.lit(False))
    assert spark.range(1).select(south).first()[0] == "56HLH"
    names = spark.range(1).select(grid.degree_tile(F.lit(5.3), F.lit(51.9)), grid.degree_tile(F.lit(-0.1), F.lit(-0.1))).first()
    assert tuple(names) == ("N51E005", "S01W001")


def test_mercator_round_trip(spark):
    x, y = grid.to_mercator(F.lit(5.0), F.lit(51.0))
    lon, lat = grid.from_mercator(x, y)
    got = spark.range(1).select(x, y, lon, lat).first()
    assert got[0] == pytest.approx(556597.4539) and got[1] == pytest.approx(6621293.7227) and got[2] == pytest.approx(5) and got[3] == pytest.approx(51)


def test_utm(spark):
    east, north = grid.to_utm(F.lit(2.2945), F.lit(48.8582), F.lit(31), F.lit(True))
    lon, lat = grid.from_utm(east, north, F.lit(31), F.lit(True))
    got = spark.range(1).select(east, north, lon, lat).first()
    assert got[0] == pytest.approx(448251.8, abs=1) and got[1] == pytest.approx(5411932.7, abs=1) and got[2] == pytest.approx(2.2945, abs=1e-9) and got[3] == pytest.approx(48.8582, abs=1e-9)


def test_resampling_methods(spark):
    values = np.arange(64.0).reshape(8, 8)
    c = flat(spark, values.tolist())
    half = c.meta.of(cell_w=2.0, cell_h=2.0)
    blocks = values.reshape(4, 2, 4, 2).transpose(0, 2, 1, 3).reshape(4, 4, 4)
    for name, f in {"average": np.mean, "min": np.min, "max": np.max, "sum": np.sum, "med": np.median, "q1": lambda v: np.quantile(v, 0.25), "rms": lambda v: np.sqrt((v * v).mean())}.items():
        got = cells(grid.resample(c, half, 4, 4, name))
        assert got == {(x, y): pytest.approx(f(blocks[y, x])) for x in range(4) for y in range(4)}
    # Kernels give a plane back between its cells, away from the edge.
    fine = c.meta.of(xmin=3.25, ymax=-3.25, cell_w=0.5, cell_h=0.5)
    for name in ("bilinear", "cubic", "cubicspline"):
        assert cells(grid.resample(c, fine, 1, 1, name))[(0, 0)] == pytest.approx(3 + 8 * 3)
    assert cells(grid.resample(c, fine, 1, 1, "lanczos"))[(0, 0)] == pytest.approx(27)
    degrees = flat(spark, [[x for x in range(20)] for _ in range(20)], xmin=2.9, ymax=51.1, cell_w=0.01, cell_h=0.01, crs="EPSG:4326")
    utm = degrees.meta.of(xmin=500000.0, ymax=5.645e6, cell_w=700.0, cell_h=1100.0, crs="EPSG:32631")
    near, smooth = cells(grid.resample(degrees, utm, 5, 5, "near")), cells(grid.resample(degrees, utm, 5, 5, "bilinear"))
    assert near[(0, 0)] == 10 and smooth[(0, 0)] == pytest.approx(10, abs=0.51) and len(near) == len(smooth) == 25


def test_layout_of_tiles(spark):
    c = flat(spark, [[x + 10 * y for x in range(6)] for y in range(4)], tile_cols=4, tile_rows=4)
    laid = grid.tile_to_layout(grid.retile(c, 4, 4), c.meta, c.meta, 6, 4)
    assert cells(laid) == cells(c)


def test_resampling(spark):
    c = flat(spark, [[0, 10], [20, 30]])
    assert cells(grid.resample_bilinear(c, c.meta.of(cell_w=0.5, cell_h=0.5), 4, 4))[(1, 1)] == pytest.approx(7.5)
    assert cells(grid.resample_nearest(c, c.meta.of(cell_w=0.5, cell_h=0.5), 4, 4))[(3, 0)] == 10
    assert grid.resample_nearest(c, c.meta, 2, 2) is c


def test_reclassify(spark):
    c = flat(spark, [[1, 2, 3, None]])
    assert list(cells(local.reclassify(c, {2: 20, 3: 30}, "Exact", nodata=-1, fallback=0)).values()) == [0, 20, 30, -1]
    assert list(cells(local.reclassify(c, {2: 20, 3: 30}, "LessThan")).values()) == [20, 30, None, None]
    with pytest.raises(Exception, match="no class"):
        local.reclassify(c, {1: 5}, strict=True).df.collect()


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(0, 0, float("nan"))], "x long, y long, v double")
    assert cells(from_cells(df, ["v"])) == {(0, 0): None}


def test_user_functions(spark):
    c = cube(spark, [(x, y, d, x + y) for x in range(3) for y in range(2) for d in D[:2]], tile_cols=2, tile_rows=2)
    got = udf.run_on_tiles(c, lambda a, ctx: udf.CubeArray(np.concatenate([a.values, a.values * ctx["k"]]), ["v", "w"]), ["v", "w"], {"k": 3})
    assert cells(got)[(2, 1, D[1])] == (3, 9)
    one = udf.run_on_series(c, lambda a, ctx: udf.CubeArray(a.values.sum(axis=0, keepdims=True), ["v"], [a.times[0]]))
    assert cells(one)[(2, 1, D[0])] == 6 and one.df.count() == 6
    for bad in (lambda a, ctx: udf.CubeArray(a.values[:, :1], ["v"]), lambda a, ctx: udf.CubeArray(a.values.astype(int), ["v"]), lambda a, ctx: udf.CubeArray(a.values, ["other"])):
        with pytest.raises(Exception, match="cells|bands"):
            udf.run_on_tiles(c, bad).df.collect()
    assert udf.with_metadata(c, lambda m, ctx: m.of(cell_w=5.0)).meta.cell_w == 5


def test_lookup_table(spark):
    table = sensors.LookupTable.parse("2,2,3,0,1,0,1,2,\n0,1,2,10,11,12")
    assert table(0.5, 1.5).tolist() == [6.5] and table(9, -4).tolist() == [10]
    c = cube(spark, [(0, 0, 0.5, 1.5)], ("a", "b"), False)
    assert cells(sensors.table_lookup(c, table, ["a", "b"], ["v"])) == {(0, 0): 6.5}


def test_correction_of_a_clear_black_sky(spark):
    clear = "\n".join(["0 1"] * 2 + ["0 0 0"] * 5 + ["0 0 0 0", "1 0 0 0", "0 0", "0 0", "0.9 0.6", "0 0 0", "0 0", "0 0", "0 0", "0 0 0", "0 0", "0 0"])
    c = flat(spark, [[2500, None]])
    got = cells(sensors.correct(c, {"v": sensors.Coefficients.parse(clear)}, {"sza": 30, "vza": 10, "raa": 100, "aot": 0.1, "ozone": 0.3}))
    assert got == {(0, 0): pytest.approx(2500), (1, 0): None}


def test_products(spark):
    p = spark.createDataFrame([("a", D[0], 1, 1), ("b", D[0], 1, 2), ("c", D[1], 9, 1)], "product string, t date, tcol int, trow int")
    assert [r.product for r in readers.search(p, "2017-01-01", "2017-01-05", (0, 0, 5, 5), {"trow": 2}).collect()] == ["b"]
    assert [r.product for r in sensors.choose_products(p, ["t", "tcol"], [F.col("product").desc()]).orderBy("product").collect()] == ["b", "c"]
    item = json.dumps({"id": "s", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2021-03-04T10:00:00Z"}, "assets": {"B04": {"href": "f.tif"}}})
    r = readers.stac_products(spark.createDataFrame([(item,)], "value string")).first()
    assert (r.product, r.t, r.xmax, r.assets) == ("s", date(2021, 3, 4), 3, {"B04": "f.tif"})


def test_path_dates(spark):
    paths = ["/a/2020/01/31/f.tif", "/x_20200229_T1.tif", "/y-2021-12-01.nc", "/none.tif"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(readers.path_date(F.col("p"), "day folders"), readers.path_date(F.col("p")), readers.path_date(F.col("p"), "dashed")).collect()]
    assert got == [(date(2020, 1, 31), None, None), (None, date(2020, 2, 29), None), (None, None, date(2021, 12, 1)), (None, None, None)]


def test_cube_tables(spark, tmp_path):
    c = cube(spark, [(x, y, d, x * y) for x in range(20) for y in range(20) for d in D[:2]])
    readers.write_cube(c, f"{tmp_path}/c")
    readers.append_cube(cube(spark, [(0, 0, D[2], 5)]), f"{tmp_path}/c")
    assert readers.read_cube(spark, f"{tmp_path}/c").df.count() == 801
    part = readers.read_cube(spark, f"{tmp_path}/c", "2017-01-05", "2017-01-06", (1, 1, 1, 1), ["v", "absent"])
    assert part.df.count() == 64 and part.df.filter("absent is null").count() == 64
    assert "PartitionFilters: [isnotnull(t" in part.df._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        readers.read_cube(spark, f"{tmp_path}/c", "2030-01-01")
    assert readers.read_cube(spark, f"{tmp_path}/c", "2030-01-01", allow_empty=True).df.count() == 0


def test_raster_files(spark, tmp_path):
    import pandas as pd

    for name, v in (("a_20200101.bin", 1), ("b_20200102.bin", 2)):
        (tmp_path / name).write_bytes(np.full((2, 2), v, "<f4").tobytes())

    def decode(content):
        a = np.frombuffer(content, "<f4").reshape(2, 2)
        y, x = np.indices(a.shape)
        return pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "v": a.ravel().astype(float)})

    rows = readers.load_files(spark, str(tmp_path), decode, "x long, y long, v double")
    assert sorted((r.t.day, r.n) for r in rows.groupBy("t").agg(F.sum("v").alias("n")).collect()) == [(1, 4), (2, 8)]


def test_sinks(spark, tmp_path):
    c = flat(spark, [[0, 5], [None, 10]])
    assert cells(RasterCube(sinks.rendered(c, 0, 10), CubeMeta(("v", "alpha"), False))) == {(0, 0): (1, 255), (1, 0): (128, 255), (0, 1): (0, 0), (1, 1): (255, 255)}
    values = sinks.stitched(c)
    assert values.shape == (1, 2, 2) and np.isnan(values[0, 1, 0])
    data = sinks.tiff(values)
    assert data[:4] == b"II*\0" and np.frombuffer(data, "<f4", 4, 8)[1] == 5
    with pytest.raises(ValueError):
        sinks.stitched(c, limit=3)
    stats = spark.createDataFrame([(D[0], 0, 1.5), (D[0], 1, None)], "t date, feature_index int, v double")
    assert json.loads(sinks.statistics_json(stats, ["v"]).first().json) == {"0": [1.5], "1": [None]}
    sinks.write_statistics(stats, f"{tmp_path}/s")
    assert spark.read.csv(f"{tmp_path}/s", header=True).count() == 2
    sinks.write_by(stats, f"{tmp_path}/b", "feature_index")
    assert spark.read.parquet(f"{tmp_path}/b").filter("feature_index = 1").count() == 1
    assert [r[0] for r in c.df.orderBy("y", "x").select(sinks.colour_map([(4, 7), (9, 8)], "v", 1)).collect()] == [7, 8, 0, 1]
    assert cells(sinks.decibels(flat(spark, [[100, 0]]), "v")) == {(0, 0): 20, (1, 0): None}


def test_dates(spark):
    one = spark.range(1)
    assert one.select(scalar.date_difference("2020-01-31", "2020-03-01", "month")).first()[0] == 1
    assert one.select(scalar.date_difference("2020-01-01T00:00:00Z", "2020-01-01T12:00:00Z")).first()[0] == 0.5
    assert str(one.select(scalar.date_shift("2020-01-31", 1, "month")).first()[0]) == "2020-02-29 00:00:00"
    assert str(one.select(scalar.date_replace_component("2020-01-31T10:11:12Z", 5, "hour")).first()[0]) == "2020-01-31 05:11:12"
    assert one.select(scalar.date_between("2020-01-05", "2020-01-01", "2020-01-05", True)).first()[0] is False
    with pytest.raises(ValueError):
        scalar.date_difference("2020-01-01", "2020-01-02", "week")


def test_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    c = cube(spark, [(x, 0, x, 10 - x) for x in range(10)] + [(50, 0, None, 1)], ("a", "b"), False)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(c.df.dropna().withColumn("label", (F.col("a") > 4).cast("double")))
    model = RandomForestClassifier(numTrees=3, seed=1).fit(rows)
    got = cells(udf.predict(c, model))
    assert got[(50, 0)] is None and got[(0, 0)] == 0 and got[(9, 0)] == 1
    assert sum(cells(udf.predict(c, model, probabilities=True))[(9, 0)]) == pytest.approx(1)
    with pytest.raises(ValueError):
        udf.predict(mask.filter_bands(c, ["a"]), model)


def test_stream_agrees_with_the_batch(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1 + i % 3, i % 24), i % 40, "view", float(i), "{}") for i in range(200)]
    df = spark.createDataFrame(rows, events.EVENTS)
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    batch = df.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.event_stream(spark, f"{tmp_path}/events.parquet", "*.parquet")
    got = events.run_once(events.windowed_cells(stream), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.windowed_cells(batch).collect()))


def test_group_by_feature_round_trip(spark):
    c = cube(spark, [(x, y, D[0], x) for x in range(4) for y in range(4)])
    grouped = zonal.group_by_feature(c, zonal.polygons(spark, [[(0, 0), (4, 0), (0, -4)]]))
    assert grouped.count() == 16 and grouped.filter("v is not null").count() == 6
    assert zonal.merge_features(grouped, c).df.count() == 16


def test_local_and_bands(spark):
    c = cube(spark, [(0, 0, D[0], 4, 2)], ("a", "b"))
    assert cells(merge.local(c, "subtract", 1, reverse=True)) == {(0, 0, D[0]): (-3, -1)}
    assert cells(local.map_bands(c, single("max"), ["m"])) == {(0, 0, D[0]): 4}
    with pytest.raises(IndexError):
        mask.filter_bands(c, [5])
    with pytest.raises(ValueError):
        RasterCube(c.df, CubeMeta(("zz",)))


@pytest.mark.parametrize("kind", ["u1", "i2", "u2", "i4", "f4", "f8"])
def test_geotiff_round_trip(kind):
    from gridloom.sources import geotiff

    rng = np.random.default_rng(2)
    values = rng.integers(1, 100, (3, 70, 45)).astype(float)
    values[0, 3, 4] = values[2, 69, 44] = np.nan
    made = geotiff.write(geotiff.Raster(values, 500000.0, 5.6e6, 10.0, 20.0, 32631, None if kind[0] == "f" else 0), tile=16, kind=kind)
    got = geotiff.read(made)
    assert np.array_equal(got.values, values, equal_nan=True)
    assert (got.xmin, got.ymax, got.cell_w, got.cell_h, got.epsg) == (500000.0, 5.6e6, 10.0, 20.0, 32631)


def test_geotiff_strips():
    from gridloom.sources import geotiff

    assert np.array_equal(geotiff.read(sinks.tiff(np.arange(24.0).reshape(2, 3, 4))).values, np.arange(24.0).reshape(2, 3, 4))
    with pytest.raises(ValueError):
        geotiff.read(b"GIF89a, not a TIFF")


def test_geotiff_files(spark, tmp_path):
    from gridloom.sources import geotiff

    c = cube(spark, [(x, y, d, x + 100 * y, x if x != 7 else None) for x in range(5, 35) for y in range(3, 20) for d in D[:2]], ("a", "b"), xmin=100.0, ymax=900.0, cell_w=10.0, cell_h=10.0, crs="EPSG:32631")
    assert geotiff.save(geotiff.files(c, cells=16), str(tmp_path)) == 2 * 3 * 2
    back = geotiff.load(spark, f"{tmp_path}/*.tif", c.meta, r"_(\d{4})(\d{2})(\d{2})_")
    assert cells(back) == cells(c)
    assert {r["name"] for r in geotiff.files(mask.at_instant(c, D[0]), cells=64, by_band=True).select("name").collect()} == {"cube_0_0_a.tif", "cube_0_0_b.tif"}


def test_loader(spark):
    from gridloom.sources import loader

    meta = CubeMeta(("v",), xmin=0.0, ymax=0.0, tile_cols=4, tile_rows=4)
    products = spark.createDataFrame([("a", D[0], 0.0, -8.0, 8.0, 0.0), ("b", D[0], 2.0, -8.0, 12.0, 0.0), ("c", D[1], 3.0, -5.0, 5.0, -3.0)], "product string, t date, xmin double, ymin double, xmax double, ymax double")
    pairs = loader.on_tiles(products, meta).cache()
    got = {(r["product"], r.tcol, r.trow): r.covers for r in pairs.collect()}
    assert {k[1:] for k in got if k[0] == "a"} == {(x, y) for x in (0, 1) for y in (0, 1)} and got["a", 1, 1] and not got["b", 0, 0] and got["b", 2, 1]
    assert {k[1:] for k in got if k[0] == "c"} == {(x, y) for x in (0, 1) for y in (0, 1)}
    kept = loader.resolve(pairs)
    assert {(r["product"], r.tcol) for r in kept.filter("t = '2017-01-01' and trow = 0").collect()} == {("a", 0), ("b", 1), ("b", 2)}
    rows = [("a", x, 0, float(x) if x != 5 else None) for x in range(8)] + [("b", x, 0, 100.0 + x) for x in range(2, 12)]
    own = spark.createDataFrame(rows, "product string, x long, y long, v double")
    ranked = pairs.withColumn("rank", F.when(F.col("product") == "a", 1).otherwise(2))
    made = cells(loader.load_products(own, ranked, meta))
    assert made[(1, 0, D[0])] == 1 and made[(5, 0, D[0])] == 105 and made[(9, 0, D[0])] == 109 and len(made) == 12
    clouds = spark.createDataFrame([("a", 0.9), ("zz", 1.0)], "product string, share double")
    assert {(r.tcol, r.trow) for r in loader.too_cloudy(pairs, clouds, 0.5).collect()} == set()
    assert (D[0], 0, 0) in {tuple(r) for r in loader.too_cloudy(pairs.filter("product = 'a'"), clouds, 0.5).collect()}


def test_local_extras(spark):
    a, b = flat(spark, [[-1, 2, None]]), flat(spark, [[5, 1, 1]])
    assert list(cells(merge.local(a, "min", b)).values()) == [-1, 1, None] and list(cells(merge.absolute(a)).values()) == [1, 2, None]
    assert set(cells(merge.difference(b, flat(spark, [[0, 0]])))) == {(2, 0)}
    assert cells(a.persist().unpersist()) == cells(a)
