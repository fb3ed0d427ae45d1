"""Stretches of equal state against the state at every step."""

import random

import pytest

from gridspark.operators import temporal


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(3), f"n{r.randrange(4)}", r.randint(0, 14), k, r.randint(0, 1)) for k in range(40)]
    events = spark.createDataFrame(rows, "run long, node string, step int, position long, kind int")
    intervals = temporal.state_intervals(events, ["run"], 12)
    got, ends = {}, {}
    for x in intervals.orderBy("run", "node", "begin").collect():
        assert ends.get((x.run, x.node), (0, None))[0] == x.begin and ends.get((x.run, x.node), (0, None))[1] != x.active  # without gaps, and each is a change
        ends[x.run, x.node] = x.until, x.active
        got |= {(x.run, x.node, s): x.active for s in range(x.begin, x.until)}
    assert got == {(x.run, x.node, x.step): x.active for x in temporal.fault_states(events, ["run"], 12).collect()}
    asked = spark.createDataFrame([(0, 3), (0, 3), (1, 11), (2, 12), (9, 0)], "run long, step int")
    some = {(x.run, x.node, x.step): x.active for x in temporal.states_at(intervals, asked, ["run"]).collect()}
    assert some == {k: v for k, v in got.items() if (k[0], k[2]) in {(0, 3), (1, 11)}}


def test_no_events(spark):
    none = spark.createDataFrame([], "run long, node string, step int, position long, kind int")
    assert temporal.state_intervals(none, ["run"], 5).isEmpty()
