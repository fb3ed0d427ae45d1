"""Places in a global order, and small frames."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import components, frames
from gridspark.operators.numbering import numbered


@pytest.mark.parametrize("n, parts", [(0, 3), (1, 5), (500, 1), (5000, 9)])
def test_places(spark, n, parts):
    r = random.Random(n)
    keys = [(r.choice((None, r.randint(0, 40))), k) for k in range(n)]
    df = spark.createDataFrame(keys, "a int, b int").repartition(parts)
    got = {(x.a, x.b): x.place for x in numbered(df, ["a", "b"], "place").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert sorted(got.values()) == list(range(n))


def test_equal_keys_have_neighbouring_places(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"))
    places = {}
    for r in numbered(df, ["k"], "p").collect():
        places.setdefault(r.k, []).append(r.p)
    assert [sorted(places[k]) for k in range(3)] == [list(range(334)), list(range(334, 667)), list(range(667, 1000))]


def test_no_window_over_all_rows(spark):
    plan = numbered(spark.range(100), ["id"], "p")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_external_grids(spark):
    rows = [(1, 5, "ExtPowerGrid", 10), (1, 3, "ExtPowerGrid", 20), (1, 9, "ExtHydrGrid", 30), (1, 8, "ExtHydrGrid", 40), (2, 1, "ExtHydrGrid", 50), (3, 1, "Sink", 60)]
    got = {r.network_id: (r.power, r.gas) for r in components.grid_balance(spark.createDataFrame(rows, "network_id long, id long, type string, v long"), "v").collect()}
    assert got == {1: (20, 30), 2: (None, None), 3: (None, None)}


def test_relevant_components(spark):
    make = lambda rows: spark.createDataFrame([(0, *r) for r in rows], "network_id long, id long, type string, grid string")
    got = components.relevant(make([(1, "PowerLoad", None), (2, "Sink", "gas"), (3, "Sink", "water"), (4, None, None)]), make([(1, "HeatExchangerLoad", None), (2, "GasPipe", "gas")])).collect()
    assert sorted((r.kind, r.id) for r in got) == [("branch", 1), ("child", 1), ("child", 2)]


def test_frames(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 3)], "x string, p long, q long")
    assert sorted(map(tuple, frames.multi_bar(df, "x", ["p", "q"]).collect())) == [("a", "p", 1.0), ("b", "p", 2.0), ("b", "q", 3.0)]
    two = spark.createDataFrame([(1, 5.0), (1, None), (2, -1.0)], "n long, color double"), spark.createDataFrame([(1, 7)], "n long, color long")
    assert sorted(map(tuple, frames.color_range(list(two), ["n"]).collect())) == [(1, 5.0, 7.0), (2, -1.0, -1.0)]
    assert [tuple(r) for r in frames.wide(spark.createDataFrame([(1, "a", 2), (1, "a", 3), (1, "c", 9)], "i long, k string, v long"), ["i"], "k", "v", ["a", "b"]).collect()] == [(1, 5, None)]
