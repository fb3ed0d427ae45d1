"""Steps of the regions' networks that grow with their tables: pairs of suppliers, arrays of all pairs, cells of groups."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.operators import graph, walks
from gridspark.plans import fixtures as fx


def test_suppliers_that_meet(spark, tmp_path):
    """Pairs are counted once for each part, whatever stands beside it; rows without a part meet nowhere."""
    r, n = random.Random(4), 12
    items = [(r.randrange(n), r.choice([None, *range(9)])) for _ in range(300)]
    spark.createDataFrame([(k, k % 4) for k in range(n)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(4)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(s, p) for s, p in items], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = {s: {p for o, p in items if o == s and p is not None} for s in range(n)}
    want = set()
    for a in range(n):
        ranked = sorted((-len(parts[a] & parts[b]), b) for b in range(n) if b != a and b % 2 == a % 2 and parts[a] & parts[b])
        want |= {(a % 2, min(a, b), max(a, b), int(a > b), (1 + -less % 50) / 10) for less, b in ranked[:2]}
    assert {tuple(x) for x in fx.losses(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("shift", [0, 1 << 61])
def test_pairs_over_batches(monkeypatch, shift):
    monkeypatch.setattr(fx, "PAIRS", 7)
    rows = sorted({(k % 2, k // 9, k * k % 13 * (1 + shift // 13)) for k in range(120)})
    rows = sorted(rows + rows[::3])
    batch = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 5], strict=True)], names=["network_id", "part", "id"]) for a in range(0, len(rows), 5)]
    got, want = {}, {}
    for out in fx._together(iter(batch)):
        for *pair, m in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[tuple(pair)] = got.get(tuple(pair), 0) + m
    for net, part in {x[:2] for x in rows}:
        ids = sorted({x[2] for x in rows if x[:2] == (net, part)})
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                want[net, a, b] = want.get((net, a, b), 0) + 1
    assert got == want and got
    assert not list(fx._together(iter(())))


@pytest.mark.parametrize("seed", range(8))
def test_small_islands_are_not_walked_source_by_source(spark, monkeypatch, seed):
    r = random.Random(seed)
    edges = [(net, *sorted((r.randrange(9), r.randrange(9))), k, r.randint(1, 3) << (30 * (seed % 2))) for net in range(3) for k in range(r.choice([3, 9, 25]))]
    frame = spark.createDataFrame(edges, "network_id long, u long, v long, key long, w long")
    columns = ["network_id", "u", "v", "key", F.round("through", 9).alias("through"), "n", "total", "reached", "parts", F.when(~F.col("parts"), F.col("rest")).alias("rest")]
    found = []
    for dense in (walks.DENSE, 0):
        monkeypatch.setattr(walks, "DENSE", dense)
        found.append(sorted(map(str, walks.walk(frame).select(*columns).collect())))
    assert found[0] == found[1]
    u, v, w = (np.array([e[c] for e in edges if e[0] == 0]) for c in (1, 2, 4))
    monkeypatch.setattr(walks, "DENSE", 512)
    assert walks.Pairs.fits(walks.Network(u, v, w))


def test_cells_of_groups_stay_arrays():
    """Cells of many groups in one batch take no more memory than those of the largest."""
    n, groups = 900, 400
    one = [np.repeat(np.arange(30), 30), np.tile(np.arange(30), 30), np.ones(n, np.int64), np.ones(n), np.ones(n)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    each = pa.StructArray.from_arrays([pa.array(np.tile(c, groups), k) for c, k in zip(one, kinds, strict=True)], names=["x", "y", "d", "p", "flow"])
    cells = pa.ListArray.from_arrays(pa.array(np.arange(groups + 1) * n, pa.int32()), each)
    tracemalloc.start()
    met = graph._joints(cells.slice(1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(met) == groups - 1 and len(set(met)) == 1 and met[0] == graph._joint(np.stack(one, 1).astype(float))
    assert peak < 4 << 20
