"""Queries over the test tables, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import RasterCube
from gridloom.functions import scalar
from gridloom.meta import CubeMeta
from gridloom.operators import focal, grid, local, mask, merge, sensors, time, udf, vector, zonal
from gridloom.plans.graph import single
from gridloom.sources import derived, sinks
from gridloom.sources.derived import EVENT_BANDS
from gridloom.sources.derived import events_cube as E
from gridloom.sources.derived import lineitem_cube as L
from gridloom.sources.derived import vectors_cube as V
from gridloom.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E_SQL = "with E as (select user_id % 16 as x, user_id // 16 as y, cast(ts as date) as t, " + ", ".join(f"avg(value) filter (event_type = '{b}') as {b}" for b in EVENT_BANDS) + " from events group by all)"
L_SQL = "with L as (select l_suppkey % 10 as x, l_partkey % 10 as y, date_trunc('month', cast(l_shipdate as date))::date as t, sum(l_quantity) as qty, avg(l_extendedprice) as price, avg(l_discount) as disc, avg(l_tax) as tax from lineitem group by all)"
V_SQL = "with V as (select 8 * (vec_id % 25) + p % 8 as x, 8 * (vec_id // 25) + p // 8 as y, floor(embedding[p + 1]::double * 1000)::double as v from embeddings, unnest(range(64)) u(p))"

ZONES = [(0, -4, 7, 0), (4, -2, 12, 0), (0, -1, 16, 0), (100, -110, 110, -100)]
ZONES_SQL = "zones(feature_index, xmin, ymin, xmax, ymax) as (values " + ", ".join(f"({i}, {a}, {b}, {c}, {d})" for i, (a, b, c, d) in enumerate(ZONES)) + ")"
IN_ZONE = "x + 0.5 >= xmin and x + 0.5 < xmax and -(y + 0.5) >= ymin and -(y + 0.5) < ymax"
TRIANGLE = [(0, 0), (12, 0), (0, -10)]
IN_TRIANGLE = "x >= 0 and y >= 0 and (x + 0.5) / 12 + (y + 0.5) / 10 < 1"
OFFSETS_3 = "o(dx, dy) as (select i, j from unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j))"


def query(sql: str | None = None, name: str | None = None):
    def keep(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns as doubles, rounded."""
    return df.select(*(F.round(F.col(c).cast("double"), digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def out(cube: RasterCube) -> DataFrame:
    return rounded(cube.df)


def node(process_id: str, *, result: bool = True, **arguments) -> dict:
    return {"process_id": process_id, "arguments": arguments, "result": result}


#: Added before rounding where exact halves of the last digit occur: engines break such ties differently.
OFF = "0.000000012345"


def off(cube: RasterCube) -> RasterCube:
    return cube.with_bands({b: F.col(b) + float(OFF) for b in cube.bands})


DATA, X = {"from_parameter": "data"}, {"from_parameter": "x"}


def element(i: int) -> dict:
    return node("array_element", result=False, data=DATA, index=i)


def ref(name: str) -> dict:
    return {"from_node": name}


# Zonal statistics


@query(f"""{E_SQL}, {ZONES_SQL}, held as (select t, feature_index, E.* exclude (t) from E join zones on {IN_ZONE}),
found as (select t, feature_index, round(avg(click), 6) as click_mean, min(click) as click_min, max(click) as click_max, round(median(click), 6) as click_median,
  count(click) as click_count, count(*) as click_count_all, round(sum(click), 6) as click_sum, round(stddev_samp(click), 6) as click_sd from held group by all)
select d.t, z.feature_index, click_mean, round(click_min, 6) as click_min, round(click_max, 6) as click_max, click_median, coalesce(click_count, 0) as click_count, coalesce(click_count_all, 0) as click_count_all, click_sum, click_sd
from (select distinct t from E) d cross join zones z left join found f on f.t = d.t and f.feature_index = z.feature_index""")
def agg_spatial_multi(spark, sf_dir):
    cube = mask.filter_bands(E(spark, sf_dir), ["click"])
    return rounded(zonal.aggregate_spatial(cube, zonal.boxes(spark, ZONES), ["mean", "min", "max", "median", "count", "count_all", "sum", "sd"]))


@query(f"""{E_SQL}, {ZONES_SQL}, found as (select t, feature_index, avg(click) as click_mean, avg(view) as view_mean from E join zones on {IN_ZONE} group by all)
select d.t, z.feature_index, round(click_mean, 6) as click_mean, round(view_mean, 6) as view_mean from (select distinct t from E) d cross join zones z left join found f on f.t = d.t and f.feature_index = z.feature_index""")
def agg_spatial_mean(spark, sf_dir):
    return rounded(zonal.aggregate_spatial(mask.filter_bands(E(spark, sf_dir), ["click", "view"]), zonal.boxes(spark, ZONES), ["mean"]))


@query(f"{E_SQL} select t, 0 as feature_index, round(avg(click), 6) as click_mean, count(click) as click_count from E where {IN_TRIANGLE} group by t")
def agg_spatial_polygon(spark, sf_dir):
    return rounded(zonal.aggregate_spatial(mask.filter_bands(E(spark, sf_dir), ["click"]), zonal.polygons(spark, [TRIANGLE]), ["mean", "count"], all_features=False))


@query(f"{E_SQL}, {ZONES_SQL} select t, feature_index, round(quantile_disc(view, 0.25), 6) as view_q25, round(quantile_disc(view, 0.9), 6) as view_q90, round(var_samp(view), 4) as view_variance from E join zones on {IN_ZONE} where view is not null group by all")
def agg_spatial_quantiles(spark, sf_dir):
    found = zonal.aggregate_spatial(mask.filter_bands(E(spark, sf_dir), ["view"]), zonal.boxes(spark, ZONES), ["variance"], False, [0.25, 0.9])
    return rounded(found.withColumn("view_variance", F.round("view_variance", 4)))


VECTOR_ZONES = [(0, -40, 60, 0), (30, -20, 200, -3)]
VZ_SQL = "zones(feature_index, xmin, ymin, xmax, ymax) as (values (0, 0, -40, 60, 0), (1, 30, -20, 200, -3))"


@query(f"{V_SQL}, {VZ_SQL} select feature_index, round(avg(v), 6) as v_mean, round(skewness_pop, 6) as v_skewness, round(kurtosis_pop(v), 6) as v_kurtosis, count(v) as v_count, arg_min(v, (y, x)) as v_first, arg_max(v, (y, x)) as v_last from (select *, avg(power(z, 3)) over (partition by feature_index) as skewness_pop from (select *, (v - avg(v) over w) / stddev_pop(v) over w as z from V join zones on {IN_ZONE} window w as (partition by feature_index))) group by feature_index, skewness_pop")
def agg_spatial_no_time(spark, sf_dir):
    return rounded(zonal.aggregate_spatial(V(spark, sf_dir), zonal.boxes(spark, VECTOR_ZONES), ["mean", "skewness", "kurtosis", "count", "first", "last"], False))


@query(f"{V_SQL}, {VZ_SQL} select feature_index, sum(v) as v_sum, count(v) as v_valid, count(*) as v_total, round(avg(v) * 0.5 + 3, 6) as physical from V join zones on {IN_ZONE} group by all")
def zonal_running_totals(spark, sf_dir):
    found = zonal.running_totals(V(spark, sf_dir), zonal.boxes(spark, VECTOR_ZONES))
    return rounded(found.withColumn("physical", zonal.physical_mean(F.col("v_sum"), F.col("v_valid"), 0.5, 3)))


@query(f"{V_SQL}, {VZ_SQL} select feature_index, round(v / 10) * 10 as value, count(*) as n from V join zones on {IN_ZONE} group by all")
def zonal_histogram(spark, sf_dir):
    cube = V(spark, sf_dir)
    return zonal.histogram(cube.with_bands({"v": F.round(F.col("v") / 10) * 10}), zonal.boxes(spark, VECTOR_ZONES))


@query(f"{E_SQL}, {ZONES_SQL} select t, round(max(click), 6) as value from E where exists (select 1 from zones where {IN_ZONE}) group by t")
def time_series_max(spark, sf_dir):
    return rounded(zonal.time_series(E(spark, sf_dir), zonal.boxes(spark, ZONES), "max"))


@query(f"{E_SQL}, {ZONES_SQL} select E.t, x, y, round(click, 6) as click from E where exists (select 1 from zones where {IN_ZONE})")
def mask_polygon(spark, sf_dir):
    return out(zonal.mask_features(mask.filter_bands(E(spark, sf_dir), ["click"]), zonal.boxes(spark, ZONES)))


@query(f"{E_SQL} select 0 as feature_index, x, y, t, round(case when {IN_TRIANGLE} then click else -1 end, 6) as click from E where x < 12 and y < 10")
def group_by_feature(spark, sf_dir):
    return rounded(zonal.group_by_feature(mask.filter_bands(E(spark, sf_dir), ["click"]), zonal.polygons(spark, [TRIANGLE]), -1.0))


@query(f"{E_SQL} select x, y, t, round(case when {IN_TRIANGLE} then click end, 6) as click from E where x < 12 and y < 10")
def merge_grouped(spark, sf_dir):
    cube = mask.filter_bands(E(spark, sf_dir), ["click"])
    return out(zonal.merge_features(zonal.group_by_feature(cube, zonal.polygons(spark, [TRIANGLE])), cube))


@query(f"{E_SQL}, p(feature_index, px, py) as (values (0, 2.3, -0.2), (1, 15.9, -3.5), (2, 500.0, -1.0)) select feature_index, t, round(click, 6) as click, round(view, 6) as view from p left join E on x = floor(px) and y = floor(-py)")
def point_values(spark, sf_dir):
    return rounded(zonal.point_values(mask.filter_bands(E(spark, sf_dir), ["click", "view"]), zonal.points(spark, [(2.3, -0.2), (15.9, -3.5), (500, -1)])))


@query(f"""{V_SQL}, p(feature_index, px, py) as (values (0, 2.25, -3.75), (1, 0.1, -0.1), (2, 70.5, -20.25)), c as (select *, px - 0.5 as gx, -py - 0.5 as gy from p),
f as (select c.*, floor(gx) + i as x, floor(gy) + j as y, (case when i = 1 then gx - floor(gx) else 1 - gx + floor(gx) end) * (case when j = 1 then gy - floor(gy) else 1 - gy + floor(gy) end) as w from c, unnest([0, 1]) a(i), unnest([0, 1]) b(j))
select feature_index, round(sum(v * w) / sum(case when v is not null then w end), 6) as v from f left join V using (x, y) where w > 0 group by all""")
def point_values_bilinear(spark, sf_dir):
    return rounded(zonal.point_values(V(spark, sf_dir), zonal.points(spark, [(2.25, -3.75), (0.1, -0.1), (70.5, -20.25)]), "bilinear"))


@query(f"{V_SQL}, {VZ_SQL} select x, y, arg_max(case feature_index when 0 then 5.0 else 7.0 end, case feature_index when 0 then 2 else 1 end)::double as value from V join zones on {IN_ZONE} group by all")
def rasterize(spark, sf_dir):
    values = spark.createDataFrame([(0, 5.0, 2), (1, 7.0, 1)], "feature_index int, value double, zindex int")
    cube = V(spark, sf_dir)
    return zonal.rasterize(cube.df, cube.meta, zonal.boxes(spark, VECTOR_ZONES), values).df


@query(f"{V_SQL} select trunc(v / 50)::integer as value, count(*) as n from V group by all")
def cell_counts(spark, sf_dir):
    return zonal.cell_counts(V(spark, sf_dir).with_bands({"v": F.col("v") / 50}))


@query(f"{L_SQL} select min(qty) as qty_min, max(qty) as qty_max, round(min(price), 6) as price_min, round(max(price), 6) as price_max from L")
def min_max(spark, sf_dir):
    return rounded(zonal.min_max(mask.filter_bands(L(spark, sf_dir), ["qty", "price"])))


@query(f"{V_SQL}, q as (select quantile_cont(v, [0.25, 0.5, 0.75, 1.0]) as q from V) select i::integer as rank, round(q[i + 1], 6) as value from q, unnest(range(4)) u(i)")
def quantile_breaks(spark, sf_dir):
    return rounded(zonal.quantile_breaks(V(spark, sf_dir), 4))


@query(f"{V_SQL} select least(greatest(floor((v + 300) / 600 * 12), 0), 11)::integer as bin, count(*) as n from V group by all")
def histogram(spark, sf_dir):
    return zonal.value_histogram(V(spark, sf_dir), -300, 300, 12)


# Reducers over time


def _reduce(name: str, sql: str):
    @query(f"{E_SQL} select x, y, round({sql.format('click')} + {OFF}, 6) as click, round({sql.format('view')} + {OFF}, 6) as view from E group by x, y", f"reduce_t_{name}")
    def run(spark, sf_dir):
        return rounded(off(time.reduce_time(mask.filter_bands(E(spark, sf_dir), ["click", "view"]), name)).df)


for _name, _sql in {
    "max": "max({0})", "min": "min({0})", "mean": "avg({0})", "sum": "sum({0})", "median": "median({0})", "sd": "stddev_samp({0})",
    "variance": "var_samp({0})", "first": "arg_min({0}, case when {0} is not null then t end)", "last": "arg_max({0}, case when {0} is not null then t end)",
}.items():
    _reduce(_name, _sql)


@query(f"{E_SQL} select x, y, nullif(count(click), 0) as click, nullif(count(view), 0) as view from E group by x, y")
def reduce_t_count(spark, sf_dir):
    return time.reduce_time(mask.filter_bands(E(spark, sf_dir), ["click", "view"]), "count").df


@query(f"{E_SQL} select x, y, count(*) filter (click > 50) as click from E group by x, y")
def reduce_t_count_condition(spark, sf_dir):
    condition = {"process_graph": {"c": node("gt", x={"from_parameter": "value"}, y=50)}}
    return time.reduce_time(mask.filter_bands(E(spark, sf_dir), ["click"]), single("count", condition=condition)).df


@query(f"{L_SQL} select x, y, round(case when count(disc) = count(*) then exp(sum(ln(disc + 1))) end, 6) as disc from L group by x, y")
def reduce_t_product(spark, sf_dir):
    cube = mask.filter_bands(L(spark, sf_dir), ["disc"])
    graph = {"a": node("add", result=False, x=DATA, y=1), "p": node("product", data=ref("a"))}
    return out(time.reduce_time(cube, graph))


@query(f"{E_SQL} select x, y, bool_or(click > 100) as any_click, bool_and(click > 1) as all_click from (select x, y, coalesce(click, 2) as click from E) group by x, y")
def reduce_t_any_all(spark, sf_dir):
    cube = mask.filter_bands(E(spark, sf_dir), ["click"]).with_bands({"click": F.coalesce("click", F.lit(2))})
    found = [time.reduce_time(cube, {"g": node("gt", result=False, x=DATA, y=v), "r": node(p, data=ref("g"))}).df.withColumnRenamed("click", f"{p}_click") for p, v in (("any", 100), ("all", 1))]
    return found[0].join(found[1], ["x", "y"])


@query(f"{E_SQL} select x, y, round(case when count(click) = count(*) then max(click) end, 6) as click from E group by x, y")
def reduce_t_strict(spark, sf_dir):
    return out(time.reduce_time(mask.filter_bands(E(spark, sf_dir), ["click"]), single("max", ignore_nodata=False)))


@query(f"{E_SQL}, q as (select x, y, quantile_cont(click, [0.1, 0.5, 0.9]) as a, quantile_cont(view, [0.1, 0.5, 0.9]) as b from E group by x, y) select x, y, round(a[1], 6) as click_q10, round(a[2], 6) as click_q50, round(a[3], 6) as click_q90, round(b[1], 6) as view_q10, round(b[2], 6) as view_q50, round(b[3], 6) as view_q90 from q")
def time_to_bands_quantiles(spark, sf_dir):
    return out(time.quantile_bands(mask.filter_bands(E(spark, sf_dir), ["click", "view"]), [0.1, 0.5, 0.9]))


@query(f"{E_SQL} select x, y, round(avg(click) * 2 + max(click), 6) as click from E group by x, y")
def reduce_t_graph(spark, sf_dir):
    graph = {"m": node("mean", result=False, data=DATA), "d": node("multiply", result=False, x=ref("m"), y=2), "x": node("max", result=False, data=DATA), "s": node("add", x=ref("d"), y=ref("x"))}
    return out(time.reduce_time(mask.filter_bands(E(spark, sf_dir), ["click"]), graph))


# Along time


@query(f"""{E_SQL}, n as (select x, y, t, click, row_number() over w as n from E window w as (partition by x, y order by t)),
g as (select *, last_value(click ignore nulls) over b as v0, last_value(case when click is not null then n end ignore nulls) over b as n0, first_value(click ignore nulls) over a as v1, first_value(case when click is not null then n end ignore nulls) over a as n1 from n
  window b as (partition by x, y order by t rows between unbounded preceding and current row), a as (partition by x, y order by t rows between current row and unbounded following))
select x, y, t, round(coalesce(click, v0 + (v1 - v0) * (n - n0) / (n1 - n0)), 6) as click from g""")
def interp_linear(spark, sf_dir):
    return out(time.interpolate_linear(mask.filter_bands(E(spark, sf_dir), ["click"])))


@query(f"{L_SQL} select x, y, t, sum(qty) over w as qty, round(max(price) over w, 6) as price from L window w as (partition by x, y order by t rows between unbounded preceding and current row)")
def apply_time_running(spark, sf_dir):
    cube = L(spark, sf_dir)
    a = time.apply_time(mask.filter_bands(cube, ["qty"]), time.running("sum"))
    b = time.apply_time(mask.filter_bands(cube, ["price"]), time.running("max"))
    return out(merge.merge_cubes(a, b))


WEEKS = time.day_spans("2024-01-01", 7, 5)
LAPS = time.day_spans("2024-01-01", 10, 3, 5)


def spans_sql(spans) -> str:
    return "s(a, b) as (values " + ", ".join(f"(date '{a}', date '{b}')" for a, b in spans) + ")"


@query(f"{E_SQL}, {spans_sql(WEEKS)}, f as (select x, y, a, avg(click) as click, avg(view) as view from E join s on t >= a and t < b group by all) select k.x, k.y, s.a as t, round(click, 6) as click, round(view, 6) as view from (select distinct x, y from E) k cross join s left join f on f.x = k.x and f.y = k.y and f.a = s.a")
def agg_temporal_week(spark, sf_dir):
    return out(time.aggregate_temporal(mask.filter_bands(E(spark, sf_dir), ["click", "view"]), time.intervals(spark, WEEKS), "mean"))


@query(f"{E_SQL}, {spans_sql(LAPS)}, f as (select x, y, a, median(click) as click from E join s on t >= a and t < b group by all) select k.x, k.y, s.a as t, round(click, 6) as click from (select distinct x, y from E) k cross join s left join f on f.x = k.x and f.y = k.y and f.a = s.a")
def agg_temporal_overlap(spark, sf_dir):
    return out(time.aggregate_temporal(mask.filter_bands(E(spark, sf_dir), ["click"]), time.intervals(spark, LAPS), "median"))


@query(f"{E_SQL}, {spans_sql(WEEKS)} select x, y, a as t, round(arg_max(click, case when click is not null then t end), 6) as click from E join s on t >= a and t < b group by all")
def agg_temporal_last_sparse(spark, sf_dir):
    return out(time.aggregate_temporal(mask.filter_bands(E(spark, sf_dir), ["click"]), time.intervals(spark, WEEKS), "last", dense=False))


@query(f"{E_SQL}, {spans_sql(LAPS)} select x, y, a as t, round(click, 6) as click from E join s on t >= a and t < b")
def instant_to_interval(spark, sf_dir):
    return out(time.instant_to_interval(mask.filter_bands(E(spark, sf_dir), ["click"]), time.intervals(spark, LAPS)))


@query(f"{E_SQL}, {spans_sql(LAPS)} select a as label, x, y, t, round(max(click) over (partition by x, y, a order by t rows between unbounded preceding and current row), 6) as click from E join s on t >= a and t < b")
def apply_in_intervals(spark, sf_dir):
    return rounded(time.apply_in_intervals(mask.filter_bands(E(spark, sf_dir), ["click"]), time.intervals(spark, LAPS), time.running("max")))


# Callbacks on bands


@query(f"{E_SQL} select x, y, t, round(case when click + view <> 0 then (click - view) / (click + view) end, 6) as ndvi from E")
def reduce_bands_ndvi(spark, sf_dir):
    graph = {"a": element(0), "b": node("array_element", result=False, data=DATA, label="view"), "n": node("normalized_difference", x=ref("a"), y=ref("b"))}
    return out(local.map_bands(E(spark, sf_dir), graph, ["ndvi"]))


def _bands(name: str, sql: str, process: str, **arguments):
    @query(f"{E_SQL} select x, y, t, round({sql} + {OFF}, 6) as r from (select *, list_filter([{', '.join(EVENT_BANDS)}], lambda v: v is not null) as a from E)", f"reduce_bands_{name}")
    def run(spark, sf_dir):
        return out(off(local.map_bands(E(spark, sf_dir), single(process, **arguments), ["r"])))


for _name, _sql, _process, _arguments in [
    ("mean", "list_avg(a)", "mean", {}), ("max", "list_max(a)", "max", {}), ("min", "list_min(a)", "min", {}), ("median", "list_median(a)", "median", {}),
    ("sum", "list_sum(a)", "sum", {}), ("sd", "case when len(a) > 1 then list_stddev_samp(a) end", "sd", {}), ("variance", "case when len(a) > 1 then list_var_samp(a) end", "variance", {}),
    ("first", "a[1]", "first", {}), ("last", "a[-1]", "last", {}), ("product", "click * error * purchase * signup * view", "product", {}),
    ("max_strict", "case when len(a) = 5 then list_max(a) end", "max", {"ignore_nodata": False}),
]:
    _bands(_name, _sql, _process, **_arguments)


@query(f"{E_SQL}, c as (select *, list_filter([{', '.join(EVENT_BANDS)}], lambda v: v is not null) as a from E) select x, y, t, nullif(len(a), 0)::integer as valid, 5 as every, len(list_filter(a, lambda v: v > 50))::integer as high from c")
def reduce_bands_count(spark, sf_dir):
    cube = E(spark, sf_dir)
    high = {"process_graph": {"c": node("gt", x=X, y=50)}}
    graph = {"a": node("count", result=False, data=DATA), "b": node("count", result=False, data=DATA, condition=True), "c": node("count", result=False, data=DATA, condition=high), "r": node("array_create", data=[ref("a"), ref("b"), ref("c")])}
    return local.map_bands(cube, graph, ["valid", "every", "high"]).df


@query(f"{E_SQL}, u as (select x, y, t, unnest([{', '.join(EVENT_BANDS)}]) as v from E), q as (select x, y, t, quantile_cont(v, [0.25, 0.75]) as q from u group by all) select x, y, t, round(q[1], 6) as q25, round(q[2], 6) as q75 from q")
def reduce_bands_quantiles(spark, sf_dir):
    return out(local.map_bands(E(spark, sf_dir), single("quantiles", probabilities=[0.25, 0.75]), ["q25", "q75"]))


def _apply(name: str, sql: str, graph: dict, cube=L, base: str = L_SQL, table: str = "L", bands: tuple[str, ...] = ("price", "disc")):
    cols = ", ".join(f"{sql.format(b)} as {b}" for b in bands)

    @query(f"{base} select x, y, t, {cols} from {table}", f"apply_{name}")
    def run(spark, sf_dir):
        return out(local.apply(mask.filter_bands(cube(spark, sf_dir), list(bands)), graph))


_apply("clip", "round(least(greatest({0}, 0.03), 30000.0), 6)", {"c": node("clip", x=X, min=0.03, max=30000.0)})
_apply("scale", "round(least(greatest(({0} - 0) / (71117 - 0) * 2.5 + 0.5, 0.5), 3.0), 6)", {"c": node("linear_scale_range", x=X, inputMin=0, inputMax=71117, outputMin=0.5, outputMax=3.0)}, bands=("price", "qty"))
_apply("scale_int", "trunc(least(greatest({0} / 50000 * 200, 0), 200))::smallint", {"c": node("linear_scale_range", x=X, inputMin=0, inputMax=50000, outputMin=0, outputMax=200)})
_apply("log", "round(ln({0} + 1) / ln(10.0), 6)", {"a": node("add", result=False, x=X, y=1), "c": node("log", x=ref("a"), base=10.0)})
_apply("trig", "round(sin({0}) + cos({0}) * tan(0.5) + atan({0}), 6)", {"s": node("sin", result=False, x=X), "c": node("cos", result=False, x=X), "t": node("tan", result=False, x=0.5), "m": node("multiply", result=False, x=ref("c"), y=ref("t")), "a": node("arctan", result=False, x=X), "r": node("sum", data=[ref("s"), ref("m"), ref("a")])})
_apply("math", "round(sqrt(abs(floor({0}) - ceil({0}) * 2)) + exp(-{0} / 100000) + power({0}, 0.5), 6)", {"f": node("floor", result=False, x=X), "c": node("ceil", result=False, x=X), "d": node("multiply", result=False, x=ref("c"), y=2), "s": node("subtract", result=False, x=ref("f"), y=ref("d")), "a": node("absolute", result=False, x=ref("s")), "q": node("sqrt", result=False, x=ref("a")), "n": node("divide", result=False, x=X, y=-100000), "e": node("exp", result=False, p=ref("n")), "p": node("power", result=False, base=X, p=0.5), "r": node("sum", data=[ref("q"), ref("e"), ref("p")])})
_apply("if", "round(case when ({0} > 50) = false then -{0} else {0} * 2 end, 6)", {"c": node("gt", result=False, x=X, y=50), "a": node("multiply", result=False, x=X, y=2), "n": node("multiply", result=False, x=X, y=-1), "r": node("if", value=ref("c"), accept=ref("a"), reject=ref("n"))}, E, E_SQL, "E", ("click", "view"))
_apply("between", "({0} >= 10 and {0} < 60)", {"c": node("between", x=X, min=10, max=60, exclude_max=True)}, E, E_SQL, "E", ("click", "view"))
_apply("logic", "case when {0} is not null then ({0} > 20) <> (not ({0} <= 40 and {0} > 30)) end", {"a": node("gt", result=False, x=X, y=20), "b": node("lte", result=False, x=X, y=40), "c": node("gt", result=False, x=X, y=30), "d": node("and", result=False, x=ref("b"), y=ref("c")), "n": node("not", result=False, x=ref("d")), "r": node("xor", x=ref("a"), y=ref("n"))}, E, E_SQL, "E", ("click", "view"))
_apply("is_nodata", "({0} is null)", {"c": node("is_nodata", x=X)}, E, E_SQL, "E", ("click", "view"))
_apply("int", "trunc({0})::integer", {"c": node("int", x=X)}, E, E_SQL, "E", ("click", "view"))
_apply("round", "round_even({0}, 0)", {"c": node("round", x=X)}, E, E_SQL, "E", ("click", "view"))


@query(f"{E_SQL} select x, y, t, case when click > 40 then 0 when error > 40 then 1 when purchase > 40 then 2 when signup > 40 then 3 when view > 40 then 4 end::smallint as i from E")
def array_find(spark, sf_dir):
    high = {"process_graph": {"g": node("gt", x=X, y=40)}}
    graph = {"a": node("array_apply", result=False, data=DATA, process=high), "f": node("array_find", data=ref("a"), value=True)}
    return local.map_bands(E(spark, sf_dir), graph, ["i"]).df


@query(f"{E_SQL} select x, y, t, round(click + 0, 6) as b0, round(error + 1, 6) as b1, round(purchase + 2, 6) as b2, round(signup + 3, 6) as b3, round(view + 4, 6) as b4 from E")
def array_apply(spark, sf_dir):
    plus = {"process_graph": {"a": node("add", x=X, y={"from_parameter": "index"})}}
    return out(local.map_bands(E(spark, sf_dir), {"a": node("array_apply", data=DATA, process=plus)}, [f"b{i}" for i in range(5)]))


@query(f"{E_SQL} select x, y, t, round(click, 6) as b0, 7 as b1, round(view, 6) as b2, round(error, 6) as b3, round(click, 6) as b4, 9 as b5 from E")
def array_concat_modify(spark, sf_dir):
    other = mask.filter_bands(E(spark, sf_dir), ["click", "view", "error"])
    graph = {"h": node("array_create", result=False, data=[ref("a"), ref("b")]), "a": element(0), "b": element(1), "e": element(2), "m": node("array_modify", result=False, data=ref("h"), values=[7], index=1), "c": node("array_concat", result=False, array1=ref("m"), array2=[ref("e"), ref("a")]), "r": node("array_append", data=ref("c"), value=9)}
    return out(local.map_bands(other, graph, [f"b{i}" for i in range(6)]))


@query(f"{E_SQL} select x, y, t, round(click, 6) as b0, round(coalesce(error, click + (purchase - click) / 2), 6) as b1, round(purchase, 6) as b2 from E")
def array_interpolate(spark, sf_dir):
    return out(local.map_bands(mask.filter_bands(E(spark, sf_dir), ["click", "error", "purchase"]), single("array_interpolate_linear"), ["b0", "b1", "b2"]))


@query("select o_orderkey, date_diff('day', o_orderdate::date, date '2000-03-01')::double as days, date_sub('month', o_orderdate, timestamp '2000-03-01')::double as months, (o_orderdate::timestamp + interval 3 month)::date as shifted, make_date(year(o_orderdate), month(o_orderdate), 1) as first, o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' as inside, round(date_diff('day', o_orderdate::date, date '2000-03-01') / 365.0, 6) as years from orders")
def date_processes(spark, sf_dir):
    d = F.col("o_orderdate")
    df = derived.table(spark, sf_dir, "orders").select(
        "o_orderkey", scalar.date_difference(d, "2000-03-01", "day").alias("days"), scalar.date_difference(d, "2000-03-01", "month").alias("months"),
        scalar.date_shift(d, 3, "month").cast("date").alias("shifted"), scalar.date_replace_component(d, 1, "day").cast("date").alias("first"),
        scalar.date_between(d, "1996-01-01", "1998-01-01", True).alias("inside"), scalar.date_difference(d, "2000-03-01", "year").alias("years"),
    )
    return rounded(df)


# Merging


@query(f"{E_SQL}, A as (select x, y, t, click from E where click < 60), B as (select x, y, t, view from E where view < 40) select coalesce(A.x, B.x) as x, coalesce(A.y, B.y) as y, coalesce(A.t, B.t) as t, round(click, 6) as click, round(view, 6) as view from A full join B on A.x = B.x and A.y = B.y and A.t = B.t")
def merge_concat(spark, sf_dir):
    cube = E(spark, sf_dir)
    a = mask.filter_bands(cube, ["click"])
    b = mask.filter_bands(cube, ["view"])
    return out(merge.merge_cubes(a.on(a.df.filter("click < 60")), b.on(b.df.filter("view < 40"))))


def _merge(name: str, sql: str):
    @query(f"{E_SQL}, A as (select x, y, t, click from E where x < 9), B as (select x, y, t, view from E where x > 4) select coalesce(A.x, B.x) as x, coalesce(A.y, B.y) as y, coalesce(A.t, B.t) as t, round(case when A.x is null then view when B.x is null then click else {sql} end, 6) as click from A full join B on A.x = B.x and A.y = B.y and A.t = B.t", f"merge_{name}")
    def run(spark, sf_dir):
        cube = E(spark, sf_dir)
        a, b = mask.filter_bands(cube, ["click"]), mask.filter_bands(cube, ["view"])
        return out(merge.merge_cubes(a.on(a.df.filter("x < 9")), b.on(b.df.filter("x > 4")), name))


for _name, _sql in {"sum": "click + view", "subtract": "click - view", "product": "click * view", "divide": "case when view <> 0 then click / view end", "max": "greatest(click, view)", "min": "least(click, view)"}.items():
    _merge(_name, _sql)


@query(f"{E_SQL}, S as (select x, y, max(click) as m from E where x < 10 group by x, y) select x, y, t, round(click - m, 6) as click from E join S using (x, y)")
def merge_spatial(spark, sf_dir):
    cube = mask.filter_bands(E(spark, sf_dir), ["click"])
    return out(merge.merge_cubes(cube, time.reduce_time(cube.on(cube.df.filter("x < 10")), "max"), "subtract"))


@query(f"{E_SQL}, S as (select x, y, max(click) as m from E group by x, y) select x, y, t, round(m - click, 6) as click from E join S using (x, y)")
def merge_spatial_swapped(spark, sf_dir):
    cube = mask.filter_bands(E(spark, sf_dir), ["click"])
    return out(merge.merge_cubes(time.reduce_time(cube, "max"), cube, "subtract"))


@query(f"{E_SQL}, A as (select x, y, max(click) as click from E where x < 12 group by x, y), B as (select x, y, min(view) as view from E where x > 3 group by x, y) select x, y, round(click, 6) as click, round(view, 6) as view from A full join B using (x, y)")
def merge_spatial_both(spark, sf_dir):
    cube = E(spark, sf_dir)
    a = time.reduce_time(mask.filter_bands(cube.on(cube.df.filter("x < 12")), ["click"]), "max")
    return out(merge.merge_cubes(a, time.reduce_time(mask.filter_bands(cube.on(cube.df.filter("x > 3")), ["view"]), "min")))


@query(f"{E_SQL} select x, y, t, round(click, 6) as click from E where x < 5 union all select x, y, t, round(click, 6) from E where x > 3")
def union_layers(spark, sf_dir):
    cube = mask.filter_bands(E(spark, sf_dir), ["click"])
    return out(merge.union_layers([cube.on(cube.df.filter("x < 5")), cube.on(cube.df.filter("x > 3"))]))


@query(f"{E_SQL}, A as (select x, y, t, click from E where x < 9), B as (select x, y, t, view from E where x > 4) select coalesce(A.x, B.x) as x, coalesce(A.y, B.y) as y, coalesce(A.t, B.t) as t, round(click, 6) as click_0, round(view, 6) as view_1 from A full join B on A.x = B.x and A.y = B.y and A.t = B.t")
def combine_bands(spark, sf_dir):
    cube = E(spark, sf_dir)
    a, b = mask.filter_bands(cube, ["click"]), mask.filter_bands(cube, ["view"])
    return out(merge.combine_bands([a.on(a.df.filter("x < 9")), b.on(b.df.filter("x > 4"))]))


@query(f"{E_SQL} select x, y, t, round(coalesce(case when x < 9 then click end, case when x > 4 then view end), 6) as b from E")
def merge_tiles(spark, sf_dir):
    cube = E(spark, sf_dir)
    a, b = mask.filter_bands(cube, ["click"]).with_bands({"b": F.col("click")}), mask.filter_bands(cube, ["view"]).with_bands({"b": F.col("view")})
    return out(merge.merge_tiles([a.on(a.df.filter("x < 9")), b.on(b.df.filter("x > 4"))]))


@query(f"{E_SQL} select a.x, a.y, a.t, round(a.click + b.view, 6) as click from E a join E b on a.x = b.x and a.y = b.y and a.t = b.t where b.x > 4")
def local_add_layer(spark, sf_dir):
    cube = E(spark, sf_dir)
    a, b = mask.filter_bands(cube, ["click"]), mask.filter_bands(cube, ["view"])
    return out(merge.local(a, "add", b.on(b.df.filter("x > 4"))))


@query(f"{L_SQL} select x, y, t, round(1000 / qty, 6) as qty, round(case when price <> 0 then 1000 / price end, 6) as price from L")
def local_divide_reverse(spark, sf_dir):
    return out(merge.local(mask.filter_bands(L(spark, sf_dir), ["qty", "price"]), "divide", 1000, reverse=True))


@query(f"{L_SQL} select x, y, t, round(power(disc, 2), 6) as disc, round(power(tax, 2), 6) as tax from L")
def local_pow(spark, sf_dir):
    return out(merge.local(mask.filter_bands(L(spark, sf_dir), ["disc", "tax"]), "pow", 2))


# Masks and filters


def _mask_cube(cube: RasterCube) -> RasterCube:
    """1 where error is high, missing where there is none, absent for x = 3."""
    m = cube.with_bands({"m": F.when(F.col("error") > 50, 1).when(F.col("error") <= 50, 0)})
    return m.on(m.df.filter("x <> 3"))


MASKED = "(x <> 3 and (error is null or error > 50))"


@query(f"{E_SQL} select x, y, t, round(case when {MASKED} then null else click end, 6) as click, round(case when {MASKED} then null else view end, 6) as view from E")
def mask_raster(spark, sf_dir):
    cube = E(spark, sf_dir)
    return out(mask.raster_mask(mask.filter_bands(cube, ["click", "view"]), _mask_cube(cube)))


@query(f"{E_SQL} select x, y, t, round(case when {MASKED} and click is not null then 10.0 else click end, 6) as click from E")
def mask_replace(spark, sf_dir):
    cube = E(spark, sf_dir)
    return out(mask.raster_mask(mask.filter_bands(cube, ["click"]), _mask_cube(cube), 10.0))


@query(f"{E_SQL}, S as (select x, y, max(error) as e from E where x < 8 group by x, y) select x, y, t, round(case when e is null or e > 150 then null else click end, 6) as click from E join S using (x, y)")
def mask_spatial(spark, sf_dir):
    cube = E(spark, sf_dir)
    top = time.reduce_time(mask.filter_bands(cube.on(cube.df.filter("x < 8")), ["error"]), "max")
    return out(mask.raster_mask(mask.filter_bands(cube, ["click"]), top.with_bands({"m": F.when(F.col("error") > 150, 1).when(F.col("error").isNotNull(), 0)})))


@query(f"{E_SQL}, k as (select distinct x // 8 as tx, y // 8 as ty, t from E where x <> 3 and error <= 50) select x, y, E.t, round(click, 6) as click from E join k on x // 8 = tx and y // 8 = ty and E.t = k.t")
def data_mask(spark, sf_dir):
    cube = E(spark, sf_dir)
    return out(mask.data_mask(mask.filter_bands(cube, ["click"]), _mask_cube(cube)))


@query(f"{E_SQL} select x, y, t, round(click, 6) as click from E where x + 0.5 >= 2.2 and x + 0.5 < 9 and -(y + 0.5) >= -5 and -(y + 0.5) < -0.4")
def filter_bbox(spark, sf_dir):
    return out(mask.filter_bbox(mask.filter_bands(E(spark, sf_dir), ["click"]), 2.2, -5, 9, -0.4))


@query(f"{V_SQL} select x, y, v from V where x // 8 between 2 and 4 and y // 8 between 0 and 1")
def filter_tiles(spark, sf_dir):
    return mask.filter_tiles(V(spark, sf_dir), 2, 0, 4, 1).df


@query(f"{E_SQL} select x, y, t, round(click, 6) as click from E where t >= date '2024-01-05' and t < date '2024-01-09'")
def filter_temporal(spark, sf_dir):
    return out(mask.filter_temporal(mask.filter_bands(E(spark, sf_dir), ["click"]), "2024-01-05", "2024-01-09"))


@query(f"{E_SQL} select x, y, t, round(click, 6) as click from E where t between date '2024-01-05' and date '2024-01-07' or t = date '2024-01-20'")
def filter_by_times(spark, sf_dir):
    return out(mask.filter_by_times(mask.filter_bands(E(spark, sf_dir), ["click"]), [("2024-01-05", "2024-01-07"), ("2024-01-20",)]))


@query(f"{E_SQL} select x, y, t, round(click, 6) as click from E where day(t) % 3 = 0")
def filter_labels(spark, sf_dir):
    return out(mask.filter_labels(mask.filter_bands(E(spark, sf_dir), ["click"]), lambda t: F.dayofmonth(t) % 3 == 0))


@query(f"{E_SQL} select x, y, t, round(view, 6) as view, round(click, 6) as click from E")
def filter_bands(spark, sf_dir):
    return out(mask.filter_bands(E(spark, sf_dir), ["view", 0]))


@query(f"{E_SQL} select x, y, t, round(click, 6) as click, round(view, 6) as view from E where coalesce(click, view) is not null")
def filter_empty(spark, sf_dir):
    return out(mask.filter_empty(mask.filter_bands(E(spark, sf_dir), ["click", "view"])))


@query(f"{V_SQL} select x - 20 as x, y - 9 as y, v from V where floor((x - 20) / 8) >= 0 and floor((y - 9) / 8) >= 0")
def filter_negative_tiles(spark, sf_dir):
    cube = V(spark, sf_dir)
    return mask.filter_negative_tiles(cube.on(cube.df.withColumns({"x": F.col("x") - 20, "y": F.col("y") - 9}))).df


@query(f"{E_SQL} select x, y, round(click, 6) as click from E where t = date '2024-01-10'")
def at_instant(spark, sf_dir):
    return out(mask.at_instant(mask.filter_bands(E(spark, sf_dir), ["click"]), "2024-01-10"))


@query(f"{E_SQL} select distinct x // 8 as tcol, y // 8 as trow, t from E")
def tile_keys(spark, sf_dir):
    return mask.tile_keys(E(spark, sf_dir))


# Grids


@query(f"{V_SQL}, xs as (select i as x, floor((3 + (i + 0.5) * 1.5)) as sx from unnest(range(130)) u(i)), ys as (select j as y, floor(-(-2 - (j + 0.5) * 0.75)) as sy from unnest(range(200)) u(j)) select xs.x, ys.y, v from V join xs on V.x = sx join ys on V.y = sy")
def resample_nearest(spark, sf_dir):
    cube = V(spark, sf_dir)
    return grid.resample_nearest(cube, cube.meta.of(xmin=3.0, ymax=-2.0, cell_w=1.5, cell_h=0.75), 130, 200).df


@query(f"{V_SQL}, a as (select i as nx, (i + 0.5) * 2.5 - 0.5 as g from unnest(range(80)) u(i)), b as (select j as ny, (j + 0.5) * 0.8 - 0.5 as h from unnest(range(60)) u(j)), xs as (select nx, floor(g) + k as x, case when k = 1 then g - floor(g) else 1 - g + floor(g) end as wx from a, unnest([0, 1]) u(k)), ys as (select ny, floor(h) + k as y, case when k = 1 then h - floor(h) else 1 - h + floor(h) end as wy from b, unnest([0, 1]) u(k)) select nx as x, ny as y, round(sum(v * wx * wy) / sum(wx * wy), 6) as v from V join xs using (x) join ys using (y) where wx > 0 and wy > 0 group by all")
def resample_bilinear(spark, sf_dir):
    cube = V(spark, sf_dir)
    return out(grid.resample_bilinear(cube, cube.meta.of(cell_w=2.5, cell_h=0.8), 80, 60))


@query(f"{V_SQL}, o(i, j) as (values (0, 0), (0, 1), (1, 0), (1, 1)) select tcol, trow, x - tcol * 16 + 2 as ix, y - trow * 16 + 1 as iy, x, y, v from (select x, y, v, floor((x - 2) / 16)::bigint + i as tcol, floor((y - 1) / 16)::bigint + j as trow from V cross join o) where tcol <= floor((x + 2) / 16) and trow <= floor((y + 1) / 16)")
def retile_overlap(spark, sf_dir):
    return grid.retile(V(spark, sf_dir), 16, 16, 2, 1).select("tcol", "trow", "ix", "iy", "x", "y", "v")


@query(f"{V_SQL} select x // 16 as tcol, y // 16 as trow, x % 16 + 2 as ix, y % 16 + 1 as iy, x, y, v from V")
def remove_overlap(spark, sf_dir):
    return grid.remove_overlap(grid.retile(V(spark, sf_dir), 16, 16, 2, 1), 16, 16, 2, 1).select("tcol", "trow", "ix", "iy", "x", "y", "v")


@query(f"{V_SQL} select 2 as zoom, x, y, v from V union all select 1, x // 2, y // 2, round(avg(v), 6) from V group by x // 2, y // 2 union all select 0, x // 4, y // 4, round(avg(v), 6) from V group by x // 4, y // 4")
def pyramid(spark, sf_dir):
    levels = grid.pyramid(V(spark, sf_dir), 2)
    return rounded(levels[2].df.withColumn("zoom", F.lit(2)).unionByName(levels[1].df.withColumn("zoom", F.lit(1))).unionByName(levels[0].df.withColumn("zoom", F.lit(0))))


@query(f"{V_SQL} select x // 2 as x, y // 2 as y, v from V where x % 2 = 0 and y % 2 = 0")
def pyramid_nearest(spark, sf_dir):
    return grid.halve(V(spark, sf_dir), "nearest").df


@query(f"{V_SQL}, xs as (select i as x, floor((i + 0.5) * 0.75) as sx from unnest(range(272)) u(i)), ys as (select j as y, floor((j + 0.5) * 0.75) as sy from unnest(range(48)) u(j)) select xs.x, ys.y, v from V join xs on V.x = sx join ys on V.y = sy")
def power_of_two(spark, sf_dir):
    cube = V(spark, sf_dir)
    return grid.power_of_two(cube.on(cube.df, tile_cols=12, tile_rows=12), 204, 36).df


@query(f"{E_SQL} select count(*) as cells, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, min(x) // 8 as tcol_min, max(x) // 8 as tcol_max, min(y) // 8 as trow_min, max(y) // 8 as trow_max, min(t) as t_min, max(t) as t_max from E")
def cube_summary(spark, sf_dir):
    return grid.summary(E(spark, sf_dir))


@query(f"{V_SQL}, k as (select distinct x // 8 as c, y // 8 as r from V) select c as tcol, r as trow, (select sum((((c >> i) & 1) << (2 * i)) + (((r >> i) & 1) << (2 * i + 1))) from unnest(range(16)) u(i))::bigint as z from k")
def z_order(spark, sf_dir):
    cube = V(spark, sf_dir)
    tx, ty = cube.meta.tile_of()
    return cube.df.select(tx.alias("tcol"), ty.alias("trow"), grid.z_order(cube).alias("z")).distinct()


@query("select o_orderkey, (case when lat < 0 then 'S' else 'N' end) || lpad(abs(lat)::varchar, 2, '0') || (case when lon < 0 then 'W' else 'E' end) || lpad(abs(lon)::varchar, 3, '0') as tile from (select o_orderkey, floor((o_custkey % 3600) / 10.0 - 180)::integer as lon, floor((o_orderkey % 1600) / 10.0 - 80)::integer as lat from orders)")
def degree_tiles(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", grid.degree_tile((F.col("o_custkey") % 3600) / 10.0 - 180, (F.col("o_orderkey") % 1600) / 10.0 - 80).alias("tile"))


@query(f"{V_SQL} select x, y, case when v is null then null when v <= -100 then 1 when v <= 0 then 2 when v <= 150 then 3 else 9 end as v from V")
def reclassify(spark, sf_dir):
    return local.reclassify(V(spark, sf_dir), {-100: 1, 0: 2, 150: 3}, fallback=9).df


@query(f"{V_SQL} select x, y, case when v > 150 then 30 when v > 0 then 20 when v > -100 then 10 end as v from V")
def reclassify_greater(spark, sf_dir):
    return local.reclassify(V(spark, sf_dir), {-100: 10, 0: 20, 150: 30}, "GreaterThan").df


@query(f"{V_SQL} select x, y, case when v <> 7 and v between -32768 and 32767 then v::smallint end as v from V")
def convert_type(spark, sf_dir):
    return local.convert(V(spark, sf_dir), "int16", 7).df


@query(f"{V_SQL} select x, y, round((v + 300) * 255 / 600, 6) as v from V")
def normalize(spark, sf_dir):
    return out(local.normalize(V(spark, sf_dir), -300, 300, 0, 255))


@query(f"{V_SQL} select x, y, (1 + round_even((least(greatest(v, -200), 200) + 200) / 400 * 254, 0))::smallint as v, 255::smallint as alpha from V")
def rendered(spark, sf_dir):
    return sinks.rendered(V(spark, sf_dir), -200, 200)


# Neighbourhoods


def _focal(name: str, op: str, sql: str, offsets, condition: str = "true", reach: int = 1):
    @query(f"{V_SQL}, o(dx, dy) as (select i, j from unnest(range(-{reach}, {reach + 1})) a(i), unnest(range(-{reach}, {reach + 1})) b(j) where {condition}) select c.x, c.y, round({sql}, 6) as v from V c cross join o join V n on n.x = c.x + dx and n.y = c.y + dy group by c.x, c.y", f"focal_{name}")
    def run(spark, sf_dir):
        return out(focal.focal(V(spark, sf_dir), op, offsets))


_focal("sum", "sum", "sum(n.v)", focal.square(1))
_focal("mean", "mean", "avg(n.v)", focal.square(1))
_focal("max", "max", "max(n.v)", focal.square(2), reach=2)
_focal("min", "min", "min(n.v)", focal.circle(2), "dx * dx + dy * dy <= 4".replace("dx", "i").replace("dy", "j"), 2)
_focal("median", "median", "median(n.v)", focal.nesw(2), "i = 0 or j = 0", 2)
_focal("sd", "sd", "stddev_pop(n.v)", focal.square(1))
_focal("annulus", "mean", "avg(n.v)", focal.annulus(1, 2), "i * i + j * j between 1 and 4", 2)


@query(f"{V_SQL}, {OFFSETS_3}, r as (select x, y, floor(v / 50) as v from V), m as (select c.x, c.y, n.v, count(*) as k from r c cross join o join r n on n.x = c.x + dx and n.y = c.y + dy group by all) select x, y, arg_max(v, (k, -v)) as v from m group by x, y")
def focal_mode(spark, sf_dir):
    cube = V(spark, sf_dir)
    return focal.focal(cube.with_bands({"v": F.floor(F.col("v") / 50).cast("double")}), "mode", focal.square(1)).df


KERNEL = [[1, 2, 1], [0, 4, 0], [-1, 0.5, -1]]
KERNEL_SQL = "k(dx, dy, w) as (values " + ", ".join(f"({j - 1}, {i - 1}, {w})" for i, row in enumerate(KERNEL) for j, w in enumerate(row)) + ")"


@query(f"{V_SQL}, {KERNEL_SQL} select c.x, c.y, round(sum(n.v * w), 6) as v from V c cross join k join V n on n.x = c.x + dx and n.y = c.y + dy group by c.x, c.y")
def kernel_3x3(spark, sf_dir):
    return out(focal.apply_kernel(V(spark, sf_dir), KERNEL))


@query(f"{V_SQL} select c.x, c.y, round(sum(n.v * (1 + abs(dx) + dy * 0.5)), 3) as v from (select * from V where x < 60 and y < 40) c cross join (select i as dx, j as dy from unnest(range(-6, 7)) a(i), unnest(range(-6, 7)) b(j)) o join (select * from V where x < 60 and y < 40) n on n.x = c.x + dx and n.y = c.y + dy group by c.x, c.y")
def kernel_fft(spark, sf_dir):
    kernel = [[1 + abs(j - 6) + (i - 6) * 0.5 for j in range(13)] for i in range(13)]
    part = mask.filter_bbox(V(spark, sf_dir), 0, -40, 60, 0)
    # One decimal less than elsewhere: the transform rounds differently; -0.0 is 0.
    return focal.apply_kernel(part, kernel).df.select("x", "y", (F.round("v", 3) + F.lit(0.0)).alias("v"))


@query()
def kernel_fft_whole(spark, sf_dir):
    """The kernel of kernel_fft over the whole cube: its rows are over one tile of 256 cells beyond sf0.01."""
    kernel = [[1 + abs(j - 6) + (i - 6) * 0.5 for j in range(13)] for i in range(13)]
    return focal.apply_kernel(V(spark, sf_dir), kernel).df.select("x", "y", (F.round("v", 3) + F.lit(0.0)).alias("v"))


def _at(dx: int, dy: int) -> str:
    return f"max(n.v) filter (dx = {dx} and dy = {dy})"


SLOPE_SQL = f"""{V_SQL}, {OFFSETS_3}, p as (select c.x, c.y, c.v as e, {', '.join(f"coalesce({_at(dx, dy)}, c.v) as {n}" for n, (dx, dy) in dict(a=(-1, -1), b=(0, -1), c=(1, -1), d=(-1, 0), f=(1, 0), g=(-1, 1), h=(0, 1), i=(1, 1)).items())}
  from V c cross join o join V n on n.x = c.x + dx and n.y = c.y + dy group by c.x, c.y, c.v),
s as (select x, y, ((c + 2 * f + i) - (a + 2 * d + g)) * 0.01 / 8 as ex, ((g + 2 * h + i) - (a + 2 * b + c)) * 0.01 / 8 as so from p)"""


@query(f"{SLOPE_SQL} select x, y, round(degrees(atan(sqrt(ex * ex + so * so))), 6) as slope from s")
def slope(spark, sf_dir):
    return out(focal.slope(V(spark, sf_dir), z_factor=0.01))


@query(f"{SLOPE_SQL} select x, y, case when ex <> 0 or so <> 0 then round(case when degrees(atan2(-ex, so)) < 0 then degrees(atan2(-ex, so)) + 360 else degrees(atan2(-ex, so)) end, 6) end as aspect from s")
def aspect(spark, sf_dir):
    return out(focal.aspect(V(spark, sf_dir), z_factor=0.01))


@query(f"{SLOPE_SQL} select x, y, round_even(127 * greatest(0, cos(radians(45)) * cos(atan(sqrt(ex * ex + so * so))) + sin(radians(45)) * sin(atan(sqrt(ex * ex + so * so))) * cos(radians(315) - atan2(-ex, so))), 0)::smallint as shade from s")
def hillshade(spark, sf_dir):
    return focal.hillshade(V(spark, sf_dir), z_factor=0.01).df


@query(f"{SLOPE_SQL} select x, y, round(6 * exp(-3.5 * abs(tan(atan(sqrt(ex * ex + so * so))) + 0.05)), 6) as slope from s")
def tobler(spark, sf_dir):
    return out(focal.tobler(focal.slope(V(spark, sf_dir), z_factor=0.01)))


@query(f"{V_SQL}, {OFFSETS_3}, k as (select c.x, c.y, count(*) filter (n.v > 0 and (dx <> 0 or dy <> 0)) as a, max(c.v) > 0 as l from V c cross join o join V n on n.x = c.x + dx and n.y = c.y + dy group by c.x, c.y) select x, y, case when a = 3 or (a = 2 and l) then 1 else 0 end as v from k")
def conway(spark, sf_dir):
    return focal.conway(V(spark, sf_dir)).df


@query(f"{V_SQL} select x, y, round(least(sqrt((x + 0.5 - 10) ** 2 + (-(y + 0.5) + 12) ** 2), sqrt((x + 0.5 - 90.5) ** 2 + (-(y + 0.5) + 3.5) ** 2)), 6) as distance from V")
def euclidean_distance(spark, sf_dir):
    at = spark.createDataFrame([(10.0, -12.0), (90.5, -3.5)], "px double, py double")
    return out(vector.euclidean_distance(V(spark, sf_dir), at))


COST_SQL = f"""with recursive {V_SQL[5:]}, f as materialized (select x, y, 1 + abs(v) / 200 as f from V where v is not null), {OFFSETS_3},
r(n, x, y, d) as (select 0, x, y, 0.0::double from f where x = 3 and y = 3 union all
  select n, x, y, min(d) from (select n + 1 as n, x, y, d from r union all
    select r.n + 1, b.x, b.y, r.d + sqrt(dx * dx + dy * dy) * (a.f + b.f) / 2 from r join f a on a.x = r.x and a.y = r.y cross join o join f b on b.x = r.x + dx and b.y = r.y + dy where dx <> 0 or dy <> 0)
  where n <= 16 and d <= 15 group by n, x, y)
select x, y, round(d, 6) as cost from r where n = 16"""


@query(COST_SQL)
def cost_distance(spark, sf_dir):
    friction = V(spark, sf_dir).with_bands({"f": 1 + F.abs(F.col("v")) / 200})
    return out(vector.cost_distance(friction, spark.createDataFrame([(3.5, -3.5)], "px double, py double"), 15.0))


REGIONS_SQL = f"""with recursive {V_SQL[5:]}, c as materialized (select x, y, case when v > 0 then 1 else 0 end as value, lpad((y + 2147483648)::varchar, 12, '0') || ':' || lpad((x + 2147483648)::varchar, 12, '0') as l from V),
e as materialized (select a.x as ax, a.y as ay, b.x as bx, b.y as b_y from c a cross join (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) join c b on b.x = a.x + dx and b.y = a.y + dy and b.value = a.value),
r(x, y, value, l, moved) as (select x, y, value, l, true from c union all
  select k.x, k.y, k.value, k.m, k.m < k.l from (select r.x, r.y, r.value, r.l, least(r.l, min(n.l)) as m from r left join e on e.ax = r.x and e.ay = r.y left join r n on n.x = e.bx and n.y = e.b_y group by r.x, r.y, r.value, r.l) k where (select bool_or(moved) from r)),
last as (select x, y, any_value(value) as value, min(l) as l from r group by x, y),
sides as (select a.l, count(*) as edges from last a cross join (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) left join last b on b.x = a.x + dx and b.y = a.y + dy where b.l is null or b.l <> a.l group by a.l)
select 'band0_' || l as id, value, count(*) as cells, any_value(edges) as edges, min(x)::double as xmin, -(max(y) + 1)::double as ymin, (max(x) + 1)::double as xmax, -min(y)::double as ymax from last join sides using (l) group by l, value"""


@query(REGIONS_SQL)
def vectorize(spark, sf_dir):
    cube = V(spark, sf_dir)
    return vector.vectorize(cube.with_bands({"v": F.when(F.col("v") > 0, 1).otherwise(0)})).select("id", "value", "cells", "edges", "xmin", "ymin", "xmax", "ymax")


def _near_sql(name: str, size: int, cut: float) -> str:
    """Cells of a mask that stay after erosion by a disc of three cells, seen through a Gaussian of so many cells."""
    r = size // 2
    return f"""{name}e as (select m.x, m.y, m.{name} and coalesce(bool_and(n.{name}) and count(n.{name}) = 5, false) as keeps from scl m cross join (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) left join scl n on n.x = m.x + dx and n.y = m.y + dy group by m.x, m.y, m.{name}),
{name}g as (select i as dx, j as dy, floor(exp(-(i * i + j * j) / (2 * ({size} / 6.0::double) ** 2)) * 10000) as w from unnest(range({-r}, {r + 1})) a(i), unnest(range({-r}, {r + 1})) b(j)),
{name}n as (select m.x + dx as x, m.y + dy as y, sum(w) / (select sum(w) from {name}g) > {cut} as near from {name}e m cross join {name}g where keeps group by m.x + dx, m.y + dy)"""


@query(f"{V_SQL}, scl as materialized (select x, y, s not in (2, 4, 5, 6, 7) as a, s in (3, 8, 9, 10, 11) as b from (select x, y, ((floor(v / 20) % 12) + 12) % 12 as s from V)), {_near_sql('a', 5, 0.057)}, {_near_sql('b', 9, 0.025)} select scl.x, scl.y, case when coalesce(an.near, false) or coalesce(bn.near, false) then 1.0 else 0.0 end::double as mask from scl left join an using (x, y) left join bn using (x, y)")
def dilation_mask(spark, sf_dir):
    cube = V(spark, sf_dir)
    return focal.dilation_mask(cube.with_bands({"scl": F.pmod(F.floor(F.col("v") / 20), F.lit(12))}), 3, kernel1=5, kernel2=9).df


@query(f"""{V_SQL}, k as (select c.x, c.y, abs(c.v - n.v) / 10000 as d, n.v * 2 + 900 as coarse from V c cross join (select i as dx, j as dy from unnest(range(-2, 3)) a(i), unnest(range(-2, 3)) b(j) where i * i + j * j <= 4) o join V n on n.x = c.x + dx and n.y = c.y + dy where c.v is not null and n.v is not null),
l as (select x, y, case {" ".join(f"when count(*) filter (d < {c}) >= 5 then {c}" for c in focal.SPECTRAL_CLASSES)} else {focal.SPECTRAL_CLASSES[-1]} end as top from k group by x, y),
u as (select k.*, min(d) filter (d > 0) over w as low, max(d) over w as high from k join l using (x, y) where d < top window w as (partition by x, y)),
w as (select *, case when d = 0 or low is null or low = high then 1.0 else 1 / (1 + exp(25 * (d - low) / (high - low) - 7.5)) end as g from u)
select V.x, V.y, round(c, 6) as coarse from V left join (select x, y, sum(g * coarse) / sum(g) as c from w group by x, y) using (x, y)""")
def sharpen(spark, sf_dir):
    cube = V(spark, sf_dir)
    made = cube.with_bands({"fine": F.col("v") + 1000, "coarse": F.col("v") * 2 + 900})
    return out(focal.sharpen(made, ["fine"], ["coarse"]))


# Products, sensors, user functions, streams


@query("select product, t, tcol, trow, price, status, priority from (select o_orderkey as product, o_orderdate::date as t, o_custkey % 20 as tcol, (o_custkey // 20) % 20 as trow, o_totalprice as price, o_orderstatus as status, o_orderpriority as priority from orders) where t >= date '1996-01-01' and t < date '1997-01-01' and tcol between 2 and 9 and trow between 0 and 10 and status = 'F' and price <= 200000 and month(t) > 3")
def search_products(spark, sf_dir):
    from gridloom.sources.readers import search

    return search(derived.products(spark, sf_dir), "1996-01-01", "1997-01-01", (2, 0, 9, 10), {"status": "F"}, {"price": 200000}, F.month("t") > 3)


@query("select t, tcol, trow, product, price from (select *, row_number() over (partition by t, tcol, trow order by priority, price desc, product) as n from (select o_orderkey as product, o_orderdate::date as t, o_custkey % 20 as tcol, (o_custkey // 20) % 20 as trow, o_totalprice as price, o_orderpriority as priority from orders)) where n = 1")
def overlap_choice(spark, sf_dir):
    found = sensors.choose_products(derived.products(spark, sf_dir), ["t", "tcol", "trow"], [F.col("priority"), F.col("price").desc(), F.col("product")])
    return found.select("t", "tcol", "trow", "product", "price")


@query("with p as (select o_orderkey as product, o_orderdate::date as t, o_custkey % 20 as tcol, o_totalprice as price from orders), a as (select product, t, tcol from p where product % 7 = 0), b as (select t as bt, tcol as k, price from p where product % 11 = 3) select a.product, a.t, a.tcol, arg_min(price, (abs(date_diff('day', bt, a.t)), bt, price)) filter (bt is not null) as price from a left join b on k = a.tcol and abs(date_diff('day', bt, a.t)) <= 10 group by all")
def closest_in_time(spark, sf_dir):
    p = derived.products(spark, sf_dir)
    return sensors.closest_in_time(p.filter("product % 7 = 0").select("product", "t", "tcol"), p.filter("product % 11 = 3"), "tcol", "t", "t", "price", 10)


@query("with a as (select o_orderkey as product, o_orderdate::date as t, o_custkey % 20 as tcol from orders), b as (select l_suppkey % 20 as k, l_shipdate::date as bt, l_extendedprice as price from lineitem) select a.product, a.t, a.tcol, arg_min(price, (abs(date_diff('day', bt, a.t)), bt, price)) filter (bt is not null) as price from a left join b on k = a.tcol and abs(date_diff('day', bt, a.t)) <= 10 group by all")
def closest_in_time_whole(spark, sf_dir):
    """For every product the price of the shipment nearest in time, of all shipments."""
    shipped = derived.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("tcol"), F.col("l_shipdate").cast("date").alias("t"), F.col("l_extendedprice").alias("price"))
    return sensors.closest_in_time(derived.products(spark, sf_dir).select("product", "t", "tcol"), shipped, "tcol", "t", "t", "price", 10)


@query(f"{L_SQL}, m as (select x // 6 as bx, y // 6 as b_y, t, avg(price) as w, avg(disc * 400000) as a, avg(qty * 1000) as r from L group by all), r as (select *, a / nullif((w + r) / 2, 0) as ratio from m), v as (select *, case when ratio is null then null when ratio >= 2 then 0.5 when ratio >= 1 then 2.0 + (ratio - 1) * (0.5 - 2.0) when ratio >= 0.25 then 5.0 + (ratio - 0.25) * ((2.0 - 5.0) / 0.75) else 5.0 end as v from r) select L.x, L.y, L.t, round(coalesce(v, avg(v) over (partition by v.t)), 6) as water_vapour from L join v on L.x // 6 = bx and L.y // 6 = b_y and L.t = v.t")
def water_vapour(spark, sf_dir):
    cube = L(spark, sf_dir).with_bands({"w": F.col("price"), "a": F.col("disc") * 400000, "r": F.col("qty") * 1000})
    return out(sensors.water_vapour(cube, "w", "a", "r", [0.25, 1.0, 2.0], [5.0, 2.0, 0.5]))


#: A made-up set of coefficients in the layout of the published files.
COEFFICIENTS = "\n".join(["-0.003 0.78", "-0.05 0.99", "0 0 0", "0 0 0", "0 0 0", "0 0 0", "0 0 0", "0.025 0.2 -0.08 0.017", "1.1 -0.19 -0.045 -0.19", "0.045 0.041", "0 0.8", "0.88 0.63", "6.8 -0.19 0.002", "-0.00001 0.00000002", "-0.0002 -0.002", "-0.003 -0.001", "-0.0005 0.0004 0.02", "-0.0026 -0.013", "-0.02 -0.01"])


_K = {n: v for n, v in zip(("h2o", "o3", "o2", "co2", "ch4", "no2", "co", "s", "t", "r", "d", "wg", "p1", "p2", "a1", "a2", "b", "c1", "c2"), ([float(x) for x in line.split()] for line in COEFFICIENTS.split("\n")), strict=True)}
_W, _G = _K["wg"][0], _K["wg"][1]
_P, _R, _A = _K["p1"] + _K["p2"], _K["a1"] + _K["a2"], _K["c1"] + _K["c2"]
CORRECTION_SQL = f"""{L_SQL}, k as (select x, y, t, price / 100000 as toa, cos(radians(20 + x * 3)) as ms, cos(radians(5.0)) as mv, 1013.0 / 1013.25 as lv, 0.2::double as aot,
  greatest(-1, least(1, -(cos(radians(20 + x * 3)) * cos(radians(5.0)) + sin(radians(20 + x * 3)) * sin(radians(5.0)) * cos(radians(120.0))))) as sc,
  {1 - _W} as rest, {3 - 3 * _W * _G} as op, sqrt({(1 - _W) * (3 - 3 * _W * _G)}) as df from L),
a as (select *, 1 / ms + 1 / mv as mass, {_K["d"][0]} + {_K["d"][1]} * aot as tau, 2 * df / op as ra, exp({_K["h2o"][0]} * pow(0.3 * (1 / ms + 1 / mv), {_K["h2o"][1]}) + {_K["o3"][0]} * pow(0.3 * (1 / ms + 1 / mv), {_K["o3"][1]})) as gas,
  {_K["r"][0]} * (0.7190443 * (1 + sc * sc) + 0.0412742) / (ms * mv) as mol, 1 - df * df * ms * ms as dm,
  ({_K["t"][0]} + {_K["t"][1]} * aot / ms + ({_K["t"][2]} * lv + {_K["t"][3]}) / (1 + ms)) * ({_K["t"][0]} + {_K["t"][1]} * aot / mv + ({_K["t"][2]} * lv + {_K["t"][3]}) / (1 + mv)) as thru from k),
b as (select *, exp(df * tau) as up, exp(-df * tau) as dn, -3 * {_W} * ms * ms / (4 * dm) as ev, 2 + 3 * ms + 3 * {_G} * rest * ms * (1 + 2 * ms) as pl, (2 - 3 * ms - 3 * {_G} * rest * ms * (1 - 2 * ms)) * exp(-tau / ms) as mi, 3 * {_W} * {_G} * mv as tn, degrees(acos(sc)) as an from a),
c as (select *, {_W} / 4 * ms / dm / (up * (1 + ra) ** 2 - dn * (1 - ra) ** 2) as so, {_G} * rest * ev as od from b),
d as (select *, so * (pl * up * (1 + ra) + mi * (1 - ra)) * (1 - tn * df / op) as q1, mv / (1 + df * mv) as l1, -so * (pl * dn * (1 - ra) + mi * (1 + ra)) * (1 + tn * df / op) as q2, mv / (1 - df * mv) as l2,
  ev + od - tn * (ev / (3 * ms) + ms * od) + {_W} * ({_P[0]} + an * ({_P[1]} + an * ({_P[2]} + an * ({_P[3]} + an * {_P[4]})))) / 4 as q3, ms * mv / (ms + mv) as l3,
  (tau + {_K["r"][0]} * lv) * mass * sc as u, tau * mass * sc as z from c),
e as (select *, (q1 * l1 * (1 - exp(-tau / l1)) + q2 * l2 * (1 - exp(-tau / l2)) + q3 * l3 * (1 - exp(-tau / l3))) / (ms * mv) as ae,
  ({_R[0]} + u * ({_R[1]} + u * ({_R[2]} + u * {_R[3]}))) - ({_K["b"][0]} + mol * ({_K["b"][1]} + mol * {_K["b"][2]})) - ({_A[0]} + z * ({_A[1]} + z * ({_A[2]} + z * {_A[3]}))) as re from d),
g as (select *, toa - (mol / 4 * lv + ae + re) * gas as li, {_K["s"][0]} * lv + {_K["s"][3]} + {_K["s"][1]} * aot + {_K["s"][2]} * aot * aot as al from e)
select x, y, t, round(greatest(li / (gas * thru + li * al), 0) * 10000, 6) as price from g"""


@query(CORRECTION_SQL)
def atmospheric_correction(spark, sf_dir):
    cube = mask.filter_bands(L(spark, sf_dir), ["price"])
    angles = {"sza": 20 + F.col("x") * 3, "vza": 5.0, "raa": 120.0, "aot": 0.2, "ozone": 0.3}
    return out(sensors.correct(cube.with_bands({"price": F.col("price") / 10}), {"price": sensors.Coefficients.parse(COEFFICIENTS)}, angles))


@query(f"{V_SQL}, m as (select x // 8 as a, y // 8 as b, max(v) as top from V group by all) select x, y, v, top - v as below from V join m on x // 8 = a and y // 8 = b")
def udf_tiles(spark, sf_dir):
    import numpy as np

    def below(cube, context):
        v = cube.values[0]
        return udf.CubeArray(np.stack([v, np.nanmax(v) - v]), ["v", "below"])

    return out(udf.run_on_tiles(V(spark, sf_dir), below, ["v", "below"]))


@query(f"{L_SQL} select x, y, max(t) as t, sum(qty) as qty from L group by x, y, x // 8, y // 8")
def udf_series(spark, sf_dir):
    import numpy as np

    def total(cube, context):
        return udf.CubeArray(np.nansum(cube.values, axis=0, keepdims=True, dtype=np.float64), cube.bands, cube.times[-1:])

    found = udf.run_on_series(mask.filter_bands(L(spark, sf_dir), ["qty"]), total, ["qty"])
    last = L(spark, sf_dir).df.groupBy("x", "y").agg(F.max("t").alias("t"))
    return rounded(found.df.drop("t").join(last, ["x", "y"]).select("x", "y", "t", "qty"))


@query(f"{E_SQL}, {ZONES_SQL} select feature_index, x, y, t, round(click * 2, 4) as click from E join zones on {IN_ZONE} where click is not null")
def udf_features(spark, sf_dir):
    def double(cube, context):
        return udf.CubeArray(cube.values.astype("float64") * context["by"], cube.bands, cube.times)

    cube = mask.filter_bands(E(spark, sf_dir), ["click"])
    found = udf.run_on_features(cube, zonal.group_by_feature(cube, zonal.boxes(spark, ZONES)), double, context={"by": 2})
    return found.select("feature_index", "x", "y", "t", F.round("click", 4).alias("click"))


@query(f"{L_SQL} select x, y, t, case when qty <= 100 or price > 5000 then 1.0 else 0.0 end::double as p0, case when qty <= 100 or price > 5000 then 0.0 else 1.0 end::double as p1 from L")
def predict_forest(spark, sf_dir):
    """A forest whose one tree is known: it is trained on four points, so its cuts are the middles 100 and 5000."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    cube = mask.filter_bands(L(spark, sf_dir), ["qty", "price"])
    rows = spark.createDataFrame([(50.0, 2500.0, 0.0), (50.0, 7500.0, 0.0), (150.0, 7500.0, 0.0), (150.0, 2500.0, 1.0)], "qty double, price double, label double")
    vectors = VectorAssembler(inputCols=["qty", "price"], outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=1, maxDepth=2, bootstrap=False, featureSubsetStrategy="all", seed=1).fit(vectors)
    return out(udf.predict(cube, model, probabilities=True))


@query("select date_trunc('day', ts)::timestamp as start, user_id % 16 as x, user_id // 16 as y, count(*) as n, round(sum(value), 6) as total from events group by all")
def window_cells(spark, sf_dir):
    found = streams.windowed_cells(derived.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end as s from events window w as (partition by user_id order by ts)), k as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval 6 hour as \"end\", count(*) as n from k group by user_id, k")
def sessions(spark, sf_dir):
    found = streams.sessions(derived.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


#: The grid that one query resamples to; kept here so that tests use it, too.
DEGREES = CubeMeta(("v",), has_time=False, xmin=0.0, ymax=0.0, cell_w=0.1, cell_h=0.1, crs="EPSG:4326")


@query(f"{V_SQL}, xs as (select i as x, floor((i + 0.5) * 20000 / (pi() / 180 * 6378137.0) / 0.1)::bigint as sx from unnest(range(110)) u(i)), ys as (select j as y, floor(-(atan(exp(-(j + 0.5) * 20000 / 6378137.0)) * 2 - pi() / 2) * (180 / pi()) / 0.1)::bigint as sy from unnest(range(60)) u(j)) select xs.x, ys.y, v from V join xs on V.x = sx join ys on V.y = sy")
def resample_mercator(spark, sf_dir):
    cube = V(spark, sf_dir)
    source = RasterCube(cube.df, DEGREES)
    return grid.resample_nearest(source, DEGREES.of(cell_w=20000.0, cell_h=20000.0, crs="EPSG:3857"), 110, 60).df


# Features with several rings, other joins and masks


HOLED = "POLYGON ((0 0, 16 0, 16 -9, 0 -9, 0 0), (4 -2, 10 -2, 10 -6, 4 -6, 4 -2))"
IN_HOLED = "x >= 0 and x < 16 and y >= 0 and y < 9 and not (x >= 4 and x < 10 and y >= 2 and y < 6)"


@query(f"{E_SQL} select t, 0 as feature_index, round(avg(click), 6) as click_mean, count(click) as click_count, count(*) as click_count_all from E where {IN_HOLED} group by t")
def agg_spatial_holes(spark, sf_dir):
    cube = mask.filter_bands(E(spark, sf_dir), ["click"])
    return rounded(zonal.aggregate_spatial(cube, vector.features_of_wkt(spark, [HOLED]), ["mean", "count", "count_all"], all_features=False))


@query(f"{V_SQL} select x, y, v from V where (x >= 10 and x < 60 and y >= 5 and y < 30 and not (x >= 20 and x < 30 and y >= 10 and y < 20)) or (x >= 100 and x < 180 and y >= 40 and y < 70)")
def mask_multipolygon(spark, sf_dir):
    parts = [[[[10, -5], [60, -5], [60, -30], [10, -30], [10, -5]], [[20, -10], [30, -10], [30, -20], [20, -20], [20, -10]]], [[[100, -40], [180, -40], [180, -70], [100, -70], [100, -40]]]]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": parts}}]})
    return zonal.mask_features(V(spark, sf_dir), vector.read_geojson(spark.createDataFrame([(text,)], "value string"))).df


@query(f"{V_SQL}, {VZ_SQL} select feature_index, count(*) filter (v > 100) as v_high_count, max(v) as v_max from V join zones on {IN_ZONE} group by all")
def agg_spatial_condition(spark, sf_dir):
    graph = {"g": node("gt", x={"from_parameter": "x"}, y=100)}
    return zonal.aggregate_spatial(V(spark, sf_dir), zonal.boxes(spark, VECTOR_ZONES), ["max"], False, conditions={"high": graph})


@query(f"{V_SQL}, s as (select 0 as f, unnest(range(0, 120)) as x, 7 as y union all select 1, 33, unnest(range(2, 50))) select f as feature_index, round(avg(v), 6) as v_mean, max(v) as v_max, count(v) as v_count from V join s using (x, y) group by f")
def agg_lines(spark, sf_dir):
    lines = vector.lines_of_wkt(spark, ["LINESTRING (0.5 -7.5, 119.5 -7.5)", "LINESTRING (33.25 -2.5, 33.25 -49.5)"])
    return rounded(zonal.aggregate_lines(V(spark, sf_dir), lines, ["mean", "max", "count"]))


@query("with a as (select s_suppkey as i, s_suppkey % 37 as x0, s_suppkey % 23 as y0 from supplier), b as (select n_nationkey as i, n_nationkey * 3 % 40 as x0, n_nationkey % 20 as y0 from nation) select a.i::integer as left_index, b.i as right_index from a join b on a.x0 <= b.x0 + 4.5 and b.x0 <= a.x0 + 2.25 and a.y0 <= b.y0 + 1.5 and b.y0 <= a.y0 + 2.25")
def features_join(spark, sf_dir):
    def box(table: str, key: str, x, y, w: float, h: float) -> DataFrame:
        rows = derived.table(spark, sf_dir, table).select(F.col(key).cast("int").alias("feature_index"), x.cast("double").alias("xmin"), y.cast("double").alias("ymin"))
        rings = F.lit(None).cast("array<array<struct<x: double, y: double>>>")
        return rows.select("feature_index", "xmin", "ymin", (F.col("xmin") + w).alias("xmax"), (F.col("ymin") + h).alias("ymax"), rings.alias("rings"))

    left = box("supplier", "s_suppkey", F.col("s_suppkey") % 37, F.col("s_suppkey") % 23, 2.25, 2.25)
    right = box("nation", "n_nationkey", F.col("n_nationkey") * 3 % 40, F.col("n_nationkey") % 20, 4.5, 1.5)
    return vector.intersecting(left, right, 5.0)


def _flags(sf: tuple) -> tuple[RasterCube, RasterCube]:
    cube = V(*sf)
    return cube.with_bands({"v": (F.col("v") > 0).cast("long")}), cube.on(cube.df.filter("x % 3 <> 0")).with_bands({"v": (F.col("v") > 100).cast("long")})


for _name, _sql in {"or": "a | b", "and": "a & b", "xor": "xor(a, b)", "add": "a + b", "multiply": "a * b"}.items():

    def _overlap(spark, sf_dir, name=_name):
        return merge.merge_cubes(*_flags((spark, sf_dir)), name).df

    query(f"{V_SQL}, k as (select x, y, (v > 0)::bigint as a, case when x % 3 <> 0 then (v > 100)::bigint end as b from V) select x, y, case when b is null then a else ({_sql})::bigint end as v from k", f"merge_{_name}")(_overlap)


@query(f"{V_SQL} select x, y, case when x % 2 = 0 and v > 50 then null else v end as v from V")
def mask_spatial_both(spark, sf_dir):
    cube = V(spark, sf_dir)
    side = cube.on(cube.df.filter("x % 2 = 0")).with_bands({"m": (F.col("v") > 50).cast("int")})
    return mask.raster_mask(cube, side).df


@query(f"{V_SQL} select x // 8 as tcol, y // 8 as trow, count(*) as cells, 1::bigint as parts from V group by all")
def partition_by_space(spark, sf_dir):
    """Cells of a tile lie in one partition."""
    cube = grid.partition_by_space(V(spark, sf_dir), 4)
    df = cube.df.withColumn("p", F.spark_partition_id())
    return df.groupBy(F.expr("x div 8").alias("tcol"), F.expr("y div 8").alias("trow")).agg(F.count("*").alias("cells"), F.count_distinct("p").alias("parts"))


@query(f"{L_SQL} select x, y, t, round(asin(disc) + {OFF}, 6) as a, round(acos(disc) + {OFF}, 6) as b, round((exp(disc) - exp(-disc)) / 2 + {OFF}, 6) as c, round((exp(disc) + exp(-disc)) / 2 + {OFF}, 6) as d, round((exp(2 * disc) - 1) / (exp(2 * disc) + 1) + {OFF}, 6) as e from L")
def apply_hyperbolic(spark, sf_dir):
    cube = mask.filter_bands(L(spark, sf_dir), ["disc"])
    made = [local.apply(cube, {"p": node(p, x=X)}) for p in ("arcsin", "arccos", "sinh", "cosh", "tanh")]
    joined = made[0].df.withColumnRenamed("disc", "a")
    for name, more in zip("bcde", made[1:], strict=True):
        joined = joined.join(more.df.withColumnRenamed("disc", name), cube.keys)
    return rounded(joined.select(*cube.keys, *((F.col(c) + float(OFF)).alias(c) for c in "abcde")))


@query(f"{L_SQL} select x, y, t, qty = 50 as a, qty <> 50 as b, qty < 50 as c, qty > 50 as d from L")
def apply_compare(spark, sf_dir):
    cube = mask.filter_bands(L(spark, sf_dir), ["qty"])
    made = [local.apply(cube, {"p": node(p, x=X, y=50)}) for p in ("eq", "neq", "lt", "gt")]
    joined = made[0].df.withColumnRenamed("qty", "a")
    for name, more in zip("bcd", made[1:], strict=True):
        joined = joined.join(more.df.withColumnRenamed("qty", name), cube.keys)
    return joined


@query(f"{E_SQL}, c as (select x // 8 as a, y // 8 as b, t, avg(case when error is not null then 1.0 else 0.0 end) as share from E group by all) select E.x, E.y, E.t, round(click, 6) as click from E join c on E.x // 8 = a and E.y // 8 = b and E.t = c.t where share < 0.5")
def without_clouded(spark, sf_dir):
    cube = E(spark, sf_dir)
    tx, ty = cube.meta.tile_of()
    clouds = cube.df.groupBy(tx.alias("tcol"), ty.alias("trow"), "t").agg(F.avg(F.col("error").isNotNull().cast("double")).alias("share"))
    return out(mask.filter_bands(sensors.without_clouded(cube, clouds, 0.5), ["click"]))


@query(f"{V_SQL}, z(i, a, b, c, d, n, w) as (values (0, 0, 60, 0, 40, 3.0, 7.0), (1, 30, 200, 3, 20, 4.0, null)) select x, y, null::timestamp as t, 'pop' as band, arg_max(n, i)::double as value from V join z on x >= a and x < b and y >= c and y < d group by x, y union all select x, y, timestamp '2021-01-05', 'b1', arg_max(coalesce(w, 'nan'::double), i)::double from V join z on x >= a and x < b and y >= c and y < d where w is not null group by x, y")
def vector_raster(spark, sf_dir):
    def feature(box: tuple, properties: dict) -> dict:
        a, b, c, d = box
        return {"type": "Feature", "properties": properties, "geometry": {"type": "Polygon", "coordinates": [[[a, -c], [b, -c], [b, -d], [a, -d], [a, -c]]]}}

    made = [feature((0, 60, 0, 40), {"pop": 3.0, "2021-01-05T00:00:00Z~b1": 7.0}), feature((30, 200, 3, 20), {"pop": 4.0})]
    text = json.dumps({"type": "FeatureCollection", "features": made})
    cube = V(spark, sf_dir)
    return vector.vector_to_raster(vector.read_geojson(spark.createDataFrame([(text,)], "value string")), cube.df, cube.meta)


@query("select o_orderkey, o_orderdate::date as folder, o_orderdate::date as compact, o_orderdate::date as dashed from orders")
def path_dates(spark, sf_dir):
    from gridloom.sources.readers import path_date

    o = derived.table(spark, sf_dir, "orders")
    names = {k: F.concat(F.lit(f"/data/{k}"), F.date_format("o_orderdate", form), F.lit("T101010.tif")) for k, form in (("folder", "/yyyy/MM/dd/"), ("compact", "_yyyyMMdd"), ("dashed", "-yyyy-MM-dd"))}
    return o.select("o_orderkey", *(path_date(names[k], kind).alias(k) for k, kind in (("folder", "day folders"), ("compact", "compact"), ("dashed", "dashed"))))


for _name, _sql in {"average": "avg(v)", "min": "min(v)", "max": "max(v)", "med": "median(v)", "q3": "quantile_cont(v, 0.75)", "rms": "sqrt(avg(v * v))", "sum": "sum(v)"}.items():

    def _resampled(spark, sf_dir, name=_name):
        cube = V(spark, sf_dir)
        edge = cube.df.agg(F.max("x"), F.max("y")).first()
        return out(grid.resample(cube, cube.meta.of(cell_w=3.0, cell_h=5.0), edge[0] // 3 + 1, edge[1] // 5 + 1, name))

    query(f"{V_SQL} select x // 3 as x, y // 5 as y, round({_sql}, 6) as v from V group by all", f"resample_{_name}")(_resampled)


@query("with p as (select s_suppkey as product, s_suppkey % 5 as dy, 8.0 * (s_suppkey % 11) - 3 as xmin, -6.0 * (s_suppkey % 7) - 9 as ymin from supplier), q as (select product, dy, xmin, xmin + 13 as xmax, ymin, ymin + 9 as ymax from p), k as (select product, dy, xmin, xmax, ymin, ymax, unnest(range(floor(xmin / 8)::bigint, ceil(xmax / 8)::bigint)) as tcol from q), m as (select *, unnest(range(floor(-ymax / 8)::bigint, ceil(-ymin / 8)::bigint)) as trow from k), c as (select *, xmin <= 8 * tcol and xmax >= 8 * tcol + 8 and ymax >= -8 * trow and ymin <= -8 * trow - 8 as covers, sqrt(((xmin + xmax) / 2 - 8 * tcol - 4) ** 2 + ((ymin + ymax) / 2 + 8 * trow + 4) ** 2) as distance from m), r as (select *, row_number() over w as rank, coalesce(bool_or(covers) over (w rows between unbounded preceding and 1 preceding), false) as hidden from c window w as (partition by dy, tcol, trow order by round(distance, 9), product)) select product, dy::integer as dy, tcol, trow, covers, rank::integer as rank from r where not hidden")
def load_products(spark, sf_dir):
    """Suppliers as products: which tile takes which, nearest first, up to the first that covers it."""
    from gridloom.sources import loader

    key = F.col("s_suppkey")
    p = derived.table(spark, sf_dir, "supplier").select(key.alias("product"), (key % 5).cast("int").alias("dy"), (key % 11 * 8.0 - 3).alias("xmin"), (key % 7 * -6.0 - 9).alias("ymin"))
    p = p.select("product", F.expr("date_add(date '2024-01-01', dy)").alias("t"), "xmin", "ymin", (F.col("xmin") + 13).alias("xmax"), (F.col("ymin") + 9).alias("ymax"))
    pairs = loader.on_tiles(p, CubeMeta(("v",), xmin=0.0, ymax=0.0)).withColumn("distance", F.round("distance", 9))
    return loader.resolve(pairs).select("product", F.datediff("t", F.lit("2024-01-01").cast("date")).alias("dy"), "tcol", "trow", "covers", "rank")
