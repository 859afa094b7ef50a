from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.meta import cell_union, constant_type, tile_size, utm_floating
from gridloom.operators.local import union_type
from gridloom.plans.graph import Compiler, GraphError, Scope, compile_bands, compile_series, single

DATA, X = {"from_parameter": "data"}, {"from_parameter": "x"}


def node(process_id, result=True, **arguments):
    return {"process_id": process_id, "arguments": arguments, "result": result}


def bands(spark, graph, *rows, **parameters):
    n = len(rows[0])
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"b{i} double" for i in range(n)))
    made = compile_bands(graph, [F.col(f"b{i}") for i in range(n)], [f"b{i}" for i in range(n)], **parameters)
    return [tuple(r) for r in df.select(*(c.alias(f"r{i}") for i, c in enumerate(made))).collect()]


def test_missing_data_rules(spark):
    rows = [(1, None, 3), (None, None, None), (1, 2, 4)]
    assert bands(spark, single("sum"), *rows) == [(4,), (None,), (7,)]
    assert bands(spark, single("sum", ignore_nodata=False), *rows) == [(None,), (None,), (7,)]
    assert bands(spark, single("product"), *rows) == [(None,), (None,), (8,)]
    assert bands(spark, single("median"), *rows) == [(2,), (None,), (2,)]
    assert bands(spark, single("variance"), *rows) == [(2,), (None,), (pytest.approx(7 / 3),)]
    assert bands(spark, single("count"), *rows) == [(2,), (None,), (3,)]
    assert bands(spark, single("count", condition=True), *rows) == [(3,)] * 3
    assert bands(spark, single("first"), (None, 2, 3)) == [(2,)] and bands(spark, single("first", ignore_nodata=False), (None, 2, 3)) == [(None,)]
    assert bands(spark, single("last"), (1, 2, None)) == [(2,)]
    assert bands(spark, single("min"), *rows) == [(1,), (None,), (1,)]


def test_if_takes_accept_for_a_missing_condition(spark):
    graph = {"a": node("array_element", False, data=DATA, index=0), "i": node("if", value={"from_node": "a"}, accept=5, reject=7)}
    assert bands(spark, graph, (None, 1), (0, 1), (2, 1)) == [(5,), (7,), (5,)]
    graph["i"]["arguments"].pop("reject")
    assert bands(spark, graph, (0, 1)) == [(None,)]


def test_arrays(spark):
    assert bands(spark, single("array_interpolate_linear"), (None, 1, None, None, 4, None)) == [(None, 1, 2, 3, 4, None)]
    assert bands(spark, single("array_find", value=3), (1, 3, 3)) == [(1,)]
    assert bands(spark, single("array_find", value=3, reverse=True), (1, 3, 3)) == [(2,)]
    assert bands(spark, single("array_find", value=9), (1, 3, 3)) == [(None,)]
    assert bands(spark, single("array_modify", values=[8, 9], index=1), (1, 2)) == [(1, 8, 9, 2)]
    assert bands(spark, single("array_modify", values=[8], index=0, length=2), (1, 2, 3)) == [(8, 3)]
    assert bands(spark, single("quantiles", q=4), (1, 2, 3, 4)) == [(1.75, 2.5, 3.25)]
    assert bands(spark, single("array_create", repeat=2), (1, 2)) == [(1, 2, 1, 2)]
    graph = {"a": node("array_element", data=DATA, label="b1")}
    assert bands(spark, graph, (1, 2)) == [(2,)]


def test_scalars(spark):
    assert bands(spark, {"c": node("clip", x=X, min=0, max=2)}, (-1,), (5,), (None,)) == [(0,), (2,), (None,)]
    assert bands(spark, {"c": node("linear_scale_range", x=X, inputMin=0, inputMax=10, outputMin=0, outputMax=255)}, (5,), (20,)) == [(127,), (255,)]
    assert bands(spark, {"c": node("divide", x=X, y=0)}, (1,)) == [(None,)]
    assert bands(spark, {"c": node("ln", x=X)}, (-1,)) == [(None,)]
    assert bands(spark, {"c": node("sqrt", x=X)}, (-1,)) == [(None,)]
    assert bands(spark, {"c": node("round", x=X)}, (2.5,), (3.5,)) == [(2,), (4,)]
    assert bands(spark, {"c": node("is_nan", x=X)}, (None,), (float("nan"),), (1,)) == [(True,), (True,), (False,)]
    assert bands(spark, {"c": node("power", base=X, p=2)}, (3,)) == [(9,)]
    assert bands(spark, {"p": node("pi", False), "c": node("multiply", x=X, y={"from_node": "p"})}, (1,)) == [(pytest.approx(3.14159265),)]
    assert bands(spark, {"c": node("normalized_difference", x=X, y=1)}, (3,), (-1,)) == [(0.5,), (None,)]


def test_constants_are_folded():
    run = lambda g: Compiler(g, Scope({"label": "B04"})).run()
    assert run({"e": node("eq", x={"from_parameter": "label"}, y="B04")}) is True
    assert run({"e": node("eq", False, x="a", y="b"), "n": node("not", x={"from_node": "e"})}) is True
    assert run({"o": node("any", data=[False, True])}) is True


def test_errors(spark):
    with pytest.raises(IndexError):
        bands(spark, {"a": node("array_element", data=DATA, index=5)}, (1, 2))
    for graph in ({"a": node("nothing", x=X)}, {"a": node("add", x={"from_node": "a"}, y=1)}, {"a": node("add", x={"from_node": "b"}, y=1)}, {"a": node("add", x={"from_parameter": "q"}, y=1)}, {"a": node("add", False, x=1, y=2)}, {"a": node("clip", x=X)}, {"a": node("array_element", data=DATA, label="zz")}):
        with pytest.raises(GraphError):
            bands(spark, graph, (1, 2))
    with pytest.raises(GraphError):
        bands(spark, {"a": node("add", x=DATA, y=[1, 2, 3])}, (1, 2))


def test_series(spark):
    df = spark.createDataFrame([(1, -10.0), (2, 4.0), (3, 5.0), (4, None)], "t int, v double")
    run = lambda g: tuple(df.agg(*(c.alias(f"r{i}") for i, c in enumerate(compile_series(g, F.col("v"), F.col("t"))))).first())
    assert run(single("median")) == (4,) and run(single("first")) == (-10,) and run(single("last")) == (5,)
    assert run(single("last", ignore_nodata=False)) == (None,) and run(single("count")) == (3,) and run(single("count", condition=True)) == (4,)
    assert run(single("max", ignore_nodata=False)) == (None,) and run(single("quantiles", probabilities=[0.5, 1.0])) == (4, 5)
    assert run({"a": node("add", False, x=DATA, y=1), "m": node("mean", False, data={"from_node": "a"}), "d": node("multiply", x={"from_node": "m"}, y=3)}) == (pytest.approx(2),)


def test_cell_types():
    assert cell_union("uint8", "int8") == "int16" and cell_union("uint16", "int16") == "int32" and cell_union("uint8", "float32") == "float32"
    assert union_type(["uint8", "uint8", "int16"]) == "int16" and constant_type(3) == "uint8" and constant_type(-3) == "int16" and constant_type(0.1) == "float32" and constant_type(0.123456789) == "float64"
    assert tile_size(1, 1) == 32 and tile_size(100, 90) == 128 and tile_size(5000, 10) == 256
    assert utm_floating(17.0, 33.0, 10) == (10, 40)
