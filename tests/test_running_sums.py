"""Sums within fault intervals by running sums, against the join with every step."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import impact

RUN = "cp_density double, experiment string, id long, step long"
COLUMNS = {"electricity": "c0", "heat": "c1"}


def made(spark, seed, runs=14, steps=40):
    r = random.Random(seed)
    run = lambda: (r.choice((0.0, 0.5, None)), r.choice(("e", "f", None)), r.choice((1, 2, None)))
    some = [run() for _ in range(runs)]
    perf = [(*r.choice(some), r.choice((None, *range(-3, steps))), r.choice((None, r.randint(-9, 99))), r.randint(0, 9)) for _ in range(300)]
    pairs = [(*r.choice(some), f"node:{n}", a, a + r.randint(-4, 25)) for n in range(12) for a in [r.randint(-5, steps)] for _ in range(3)]
    nodes = [(d, f"node:{n}", "Bus") for n in range(14) for d in (0.0, 0.5)]
    frames = ((perf, RUN + ", c0 long, c1 long"), (pairs, RUN.replace("step", "failed").replace("id long", "id long, node string") + ", repaired long"), (nodes, "cp_density double, node string, type string"))
    return [spark.createDataFrame(rows, schema) for rows, schema in frames]


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 7), (3, 1)])
def test_sums_and_impacts(spark, seed, block):
    perf, pairs, nodes = made(spark, seed)
    names = [f"in_{k}_{c}" for c in COLUMNS.values() for k in "sn"]
    plain = impact.inside(perf, pairs).groupBy("cp_density", "node").agg(*(f(c).alias(f"in_{k}_{c}") for c in COLUMNS.values() for k, f in (("s", F.sum), ("n", F.count))))
    want = {(r.cp_density, r.node): tuple(r[c] or 0 for c in names) for r in plain.collect()}
    got = {(r.cp_density, r.node): tuple(r[c] for c in names) for r in impact.interval_sums(perf, pairs, list(COLUMNS.values()), block).collect()}
    assert want and {k: v for k, v in got.items() if any(v)} == {k: v for k, v in want.items() if any(v)} and want.keys() <= got.keys()
    a, b = (sorted(map(tuple, f(perf, pairs, nodes, COLUMNS, 10.0).collect()), key=repr) for f in (impact.impact, impact.impact_by_running_sums))
    assert a == b


def test_no_rows(spark):
    perf, pairs, nodes = made(spark, 4)
    assert impact.interval_sums(perf.limit(0), pairs, ["c0"]).where("in_n_c0 <> 0").isEmpty()
    assert impact.interval_sums(perf, pairs.limit(0), ["c0"]).isEmpty()
    assert {r.impact for r in impact.impact_by_running_sums(perf.limit(0), pairs, nodes, COLUMNS).collect()} == {None}


def test_work_does_not_grow_with_intervals(spark):
    """No join has a condition on steps, so no row is made for a step of an interval."""
    perf, pairs, _ = made(spark, 5)
    plan = impact.interval_sums(perf, pairs, ["c0"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any(s in line for line in plan.splitlines() if "Join" in line for s in (">=", "<=", "failed", "repaired"))
