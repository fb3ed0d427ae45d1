"""The filter and smoother as a scan, against one loop over the series."""

import random

import numpy as np
import pytest

from gridspark.operators import kalman, stopping


def frames(spark, lengths, *numbers):
    q, r, m0, p0 = map(float, numbers)
    x = random.Random(3)
    data = {k: [x.gauss(0, 2) + k for _ in range(n)] for k, n in enumerate(lengths)}
    rows = [(k, t, y) for k, ys in data.items() for t, y in enumerate(ys)]
    x.shuffle(rows)
    params = spark.createDataFrame([(k, q, r, m0, p0) for k in data], "k long, q double, r double, m0 double, p0 double")
    return data, spark.createDataFrame(rows, "k long, t long, y double"), params


@pytest.mark.parametrize("block, q, r, m0, p0", [(1024, 0.3, 1.5, 1.0, 2.0), (7, 0.3, 1.5, 1.0, 2.0), (1, 0.0, 0.5, -1.0, 0.0), (16, 0.0, 1.0, 0.0, 1.0)])
def test_smoothed_in_blocks(spark, block, q, r, m0, p0):
    data, series, params = frames(spark, (1, 2, 16, 65), q, r, m0, p0)
    got = {k: [] for k in data}
    for x in kalman.smoothed(series, params, ["k"], block).orderBy("k", "t").collect():
        got[x.k].append(x)
    for k, ys in data.items():
        mean, var, link = stopping.KalmanEvidence._smooth(np.array(ys), q, r, m0, p0)
        assert [x.y for x in got[k]] == ys
        assert np.allclose([x.mean for x in got[k]], mean, atol=1e-9) and np.allclose([x["var"] for x in got[k]], var, atol=1e-9)
        change = (mean[1:] - mean[:-1]) ** 2 + var[1:] + var[:-1] - 2 * link[1:]
        assert got[k][-1].change is None and np.allclose([x.change for x in got[k][:-1]], change, atol=1e-9)


def test_learnt_parameters(spark):
    data, series, _ = frames(spark, (1, 40), 0, 1, 0, 1)
    got = {x.k: (x.q, x.r, x.m0, x.p0) for x in kalman.learnt(series, ["k"], 1.0, rounds=3, block=16).collect()}
    for k, ys in data.items():
        y, (q, r, m0, p0) = np.array(ys), (0.0, 1.0, 0.0, 1.0)
        for _ in range(3):
            mean, var, link = stopping.KalmanEvidence._smooth(y, q, r, m0, p0)
            r = float(np.mean((y - mean) ** 2 + var))
            q = float(np.mean((mean[1:] - mean[:-1]) ** 2 + var[1:] + var[:-1] - 2 * link[1:])) if len(y) > 1 else q
            m0, p0 = float(mean[0]), float(var[0])
        assert got[k] == pytest.approx((q, r, m0, p0), rel=1e-9)


def test_elements_join_in_any_grouping():
    x = random.Random(4)
    parts = [kalman.step(x.gauss(0, 1), 0.4, 1.2) for _ in range(9)]
    whole = parts[0]
    for p in parts[1:]:
        whole = kalman.joined(whole, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = kalman.joined(p, right)
    assert whole == pytest.approx(right)


def test_no_series(spark):
    _, series, params = frames(spark, (3,), 0.1, 1.0, 0.0, 1.0)
    assert kalman.smoothed(series.limit(0), params, ["k"]).isEmpty() and kalman.smoothed(series, params.limit(0), ["k"]).isEmpty()
