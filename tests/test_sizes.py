"""What a step costs must follow its input: plans and tasks that tables of any size go through."""

import contextlib
import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import cascade, graph, kalman, powerflow, sparse, walks


def plan(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_run_of_a_cascade_is_no_frame_of_its_own(spark):
    v = spark.range(600).select((F.col("id") % 200).alias("run_id"), F.floor(F.col("id") / 200).alias("step"), F.lit(0).alias("position"), F.lit(7).alias("component_id"), F.when(F.col("id") < 200, 0.5).otherwise(0.0).alias("violation"), F.lit(0.0).alias("u_fail"), F.lit(0.0).alias("u_duration"))
    out = cascade.cascade(v, early_repair=False)
    assert "InPandas" not in plan(out)
    assert out.groupBy("type", "step").count().orderBy("step").collect() == [("cascading failure", 0, 200), ("cascading repair", 1, 200)]


def test_a_block_of_a_series_is_no_frame_of_its_own(spark):
    series = spark.range(400).select((F.col("id") % 20).alias("k"), F.floor(F.col("id") / 20).alias("t"), (F.col("id") % 7).cast("double").alias("y"))
    params = series.select("k").distinct().select("k", F.lit(0.5).alias("q"), F.lit(2.0).alias("r"), F.lit(0.0).alias("m0"), F.lit(1.0).alias("p0"))
    short, long = (kalman.smoothed(series, params, ["k"], block) for block in (4, 64))
    assert "InPandas" not in plan(short)
    both = short.join(long.select("k", "t", F.col("mean").alias("m")), ["k", "t"])
    assert both.count() == 400 and both.where("abs(mean - m) > 1e-12").isEmpty()


def _met(arcs: list, group: set) -> float:
    """Share of shortest paths between others that meet the group, summed over ordered pairs, path by path."""
    near: dict = {}
    for u, v, _, w in arcs:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))

    def paths(at: list, left: int, to: int) -> list:
        if at[-1] == to:
            return [at] if left == 0 else []
        return [p for b, w in near[at[-1]] if b not in at and w <= left for p in paths([*at, b], left - w, to)]

    total = 0.0
    for s in near:
        for t in near:
            if s != t and not {s, t} & group:
                found = next((f for d in range(1, 9) if (f := paths([s], d, t))), [])
                total += sum(bool(group & set(p)) for p in found) / len(found) if found else 0.0
    return total


def test_walks_and_groups_stay_in_their_island(spark):
    arcs = [(10 * i + a, 10 * i + b, 0, w) for i in range(6) for a, b, w in ((0, 1, 1), (1, 2, 1), (2, 3, 2), (3, 0, 1), (3, 4, 1))]
    edges = spark.createDataFrame([(0, *a) for a in arcs], "network_id long, u long, v long, key long, w long")
    cut = walks.islands(edges).orderBy("island").collect()
    assert [(r.n, r.island, r.ids, len(r.u)) for r in cut] == [(30, 10 * i, [10 * i + k for k in range(5)], 5) for i in range(6)]
    members = [1, 3, 11, 13, 14, 21]
    got = graph.group_betweenness(edges, spark.createDataFrame([(0, 7, members)], "network_id long, group_id long, members array<long>")).first().betweenness_centrality
    assert abs(got - _met(arcs, set(members)) / (24 * 23)) < 1e-12


def test_factors_of_islands_make_those_of_the_network():
    rng = np.random.default_rng(5)
    r, c = (np.concatenate([12 * k + x for k in range(3)]) for x in np.indices((12, 12)).reshape(2, -1))
    value = rng.standard_normal(len(r)) + np.where(r == c, 9.0, 0.0)
    parts = [sparse.Factor.of(*p) for p in powerflow._islands(r, c, value)]
    assert len(parts) == 3
    dense, right = np.zeros((36, 36)), rng.standard_normal((36, 2))
    dense[r, c] = value
    whole = sparse.Factor.side_by_side(parts)
    assert np.allclose(dense @ whole.solve(right), right) and np.allclose(dense.T @ whole.solve_turned(right), right)
    assert not powerflow._adrift(r, c, value)
    two = np.array([[4.0, 1.0, -4.0, 2.0], [1.0, 5.0, -1.0, 0.5], [-4.0, 2.0, 4.0, 1.0], [-1.0, 0.5, 1.0, 5.0]])
    assert powerflow._adrift(*np.indices((4, 4)).reshape(2, -1), two.ravel())  # no slack holds an angle
