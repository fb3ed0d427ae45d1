"""Hand-made cases of the library's operators."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions import rng, scalar
from gridspark.operators import cascade, frames, graph, impact, powerflow, simulation, stopping, temporal
from gridspark.plans.queries import QUERIES
from gridspark.sources import experiments, networks, profiles
from gridspark.streaming import faults

PATH, STAR, CYCLE = [(0, 1), (1, 2)], [(0, 1), (0, 2), (0, 3)], [(0, 1), (1, 2), (2, 3), (0, 3)]


def edges(spark, *networks):
    return spark.createDataFrame([(k, u, v, 0, 1) for k, e in enumerate(networks) for u, v in e], "network_id long, u long, v long, key long, w long")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("inside, outside, want", [(4.0, 2.0, 2.0), (2.0, 4.0, -2.0), (3.0, 3.0, -1.0), (None, 1.0, None)])
def test_impact_ratio(spark, inside, outside, want):
    got = one(spark, scalar.impact_ratio(F.lit(inside).cast("double"), F.lit(outside).cast("double")))
    assert got is None if want is None else got == pytest.approx(want)


def test_interval_is_closed_and_pairs_are_exact(spark):
    run = "cp_density double, experiment string, id long"
    perf = spark.createDataFrame([(0.0, "e", 1, s, 1) for s in range(10)], run + ", step long, c0 long")
    fails = spark.createDataFrame([(0.0, "e", 1, 3, "a:b:4"), (0.0, "e", 1, 1, "a:b:5"), (0.0, "e", 1, 2, "a:b:5"), (0.0, "e", 1, 2, "a:b:6")], run + ", step long, node string")
    repairs = spark.createDataFrame([(0.0, "e", 1, 7, "a:b:4"), (0.0, "e", 1, 7, "a:b:5")], run + ", step long, node string")
    pairs = impact.fault_pairs(fails, repairs)
    assert [(r.node, r.failed, r.repaired) for r in pairs.collect()] == [("node:4", 3, 7)]
    assert sorted(r.step for r in impact.inside(perf, pairs).collect()) == [3, 4, 5, 6, 7]
    nodes = spark.createDataFrame([(0.0, "node:4"), (0.0, "node:9")], "cp_density double, node string")
    got = {r.node: r["count"] for r in impact.outside(perf, pairs, nodes).groupBy("node").count().collect()}
    assert got == {"node:4": 5, "node:9": 10}


@pytest.mark.parametrize("name, key", [("x:PowerToHeatControlNode:9", "compound:9"), ("a:b:(0, 1, 0)", "branch:(0, 1, 0)"), ("a:b:4", "node:4"), ("n.child.2:Sink:7", "child:7"), ("n.child.2:CHP:7", "compound:7")])
def test_component_key(spark, name, key):
    assert one(spark, scalar.component_key(F.lit(name))) == key


def test_scenario_means_of_sums(spark):
    rows = [(0.0, "data/res/n-1-1-1-1-0", 1, 0, 1, 2, 3), (0.0, "data/res/n-1-1-1-1-0", 1, 1, 1, 2, 3), (0.0, "data/res/n-1-1-1-1-0", 2, 0, 3, 2, 1)]
    perf = spark.createDataFrame(rows, "cp_density double, experiment string, id long, step long, a long, b long, c long")
    got = {r.carrier: (r.scenario, r.resilience_mean) for r in impact.scenario_resilience(perf, {"electricity": "a", "heat": "b", "gas": "c"}).collect()}
    assert got == {"electricity": ("low overall", 2.5), "heat": ("low overall", 3.0), "gas": ("low overall", 3.5)}


def test_probabilities(spark):
    assert one(spark, scalar.incident_density(F.lit(0), 3, 0)) == pytest.approx(0.129518, abs=1e-6)
    p = scalar.failure_probability(F.lit("CHP"), F.lit("power"), F.lit(0), F.lit(1.0), timesteps=3, shift=0, power=5, base_fail=0.3)
    assert one(spark, p) == pytest.approx(0.0194276, abs=1e-7)
    assert one(spark, scalar.failure_probability(F.lit("?"), F.lit("power"), F.lit(0), F.lit(1.0))) == 0
    assert one(spark, scalar.relative_violation(F.lit(1.2), F.lit(1.0), F.lit(0.1))) == pytest.approx(1.0)
    assert one(spark, scalar.violation_probability(F.lit(0.01))) == pytest.approx(0.01)
    assert one(spark, scalar.violation_probability(F.lit(-1.0))) == 0


def test_repair_time_truncates(spark):
    time, n = F.lit(1), F.lit(5.0)
    assert one(spark, (time + scalar.repair_duration(F.lit(0.0), 5, n, 3)).cast("int")) == 11
    assert one(spark, (time + scalar.repair_duration(F.lit(0.0), 5, F.lit(-20.0), 3)).cast("int")) == 4


def test_random_numbers_do_not_depend_on_partitions(spark):
    draws = lambda n: sorted(spark.range(2000).repartition(n).select(rng.uniform(7, F.col("id")).alias("u"), rng.normal(0, 1, 7, F.col("id")).alias("z")).collect())
    a = draws(1)
    assert a == draws(7) and all(0 <= u < 1 for u, _ in a)
    z = np.array([z for _, z in a])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1


def test_carried_forward(spark):
    df = spark.createDataFrame([(1, s, float(s) if s in (0, 3, 7) else None) for s in range(10)], "run long, step long, v double")
    assert [r.v for r in temporal.carried_forward(df, ["run"], ["v"]).orderBy("step").collect()] == [0.0] * 3 + [3.0] * 4 + [7.0] * 3


def test_first_repair_ends_all_faults(spark):
    ev = spark.createDataFrame([(1, "a", 1, 0, 0), (1, "a", 2, 1, 0), (1, "a", 3, 0, 1), (1, "a", 5, 1, 1)], "run long, node string, step int, position long, kind int")
    assert [r.active for r in temporal.fault_states(ev, ["run"], 6).orderBy("step").collect()] == [True, False, False, True, True, True]


def test_graph_metrics(spark):
    e = edges(spark, PATH, STAR, CYCLE)
    bc = {(r.network_id, r.id): r.betweenness_centrality for r in graph.betweenness(e).collect()}
    assert [bc[0, i] for i in range(3)] == [0, 1, 0] and bc[1, 0] == 1 and bc[2, 0] == pytest.approx(1 / 6)
    vc = {(r.network_id, r.id): r.vc for r in graph.vitality(e).collect()}
    assert vc[0, 0] == 3 and vc[0, 1] == -math.inf and vc[2, 0] == 8 - 4
    assert {r.id: r.degree for r in graph.degree(edges(spark, [(0, 0), (0, 1)])).collect()} == {0: 3, 1: 1}
    eb = {(r.u, r.v): r.betweenness_centrality for r in graph.edge_betweenness(edges(spark, PATH)).collect()}
    assert eb == {(0, 1): pytest.approx(2 / 3), (1, 2): pytest.approx(2 / 3)}
    g = spark.createDataFrame([(1, 5, [0])], "network_id long, group_id long, members array<long>")
    assert graph.group_betweenness(e, g).first().betweenness_centrality == 1
    k = {r.id: r.katz for r in graph.katz(edges(spark, STAR)).collect()}
    assert sum(x * x for x in k.values()) == pytest.approx(1) and k[0] > k[1] == pytest.approx(k[3])
    with pytest.raises(Exception, match="diverges"):
        graph.katz(edges(spark, STAR), alpha=1.0).collect()


def line(r=0.0, x=0.1, tap=0.0):
    return pd.DataFrame({"network_id": [0], "branch": [1], "f": [0], "t": [1], "r": [r], "x": [x], "g_fr": [0.0], "b_fr": [0.0], "g_to": [0.0], "b_to": [0.0], "tap": [tap], "shift": [0.0], "vi": [1.0], "vj": [0.99], "theta_i": [0.0], "theta_j": [-0.05]})


def test_admittance(spark):
    got = {(r.i, r.j): (r.re, r.im) for r in powerflow.admittance(spark.createDataFrame(line())).collect()}
    assert {k: (round(a, 9) + 0, round(b, 9)) for k, (a, b) in got.items()} == {(0, 0): (0, -10), (1, 1): (0, -10), (0, 1): (0, 10), (1, 0): (0, 10)}


def test_jacobian_against_differences(spark):
    rows = spark.createDataFrame(pd.concat([line(0.02, 0.1, 0.98), line(0.03, 0.2).assign(f=1, t=2, branch=2, shift=0.02, b_to=0.03)], ignore_index=True))
    cells, kinds = powerflow.admittance(rows), ["slack", "pv", "pq"]

    def buses(theta, v):
        return spark.createDataFrame([(0, i, kinds[i], float(theta[i]), float(v[i])) for i in range(3)], "network_id long, id long, bus_type string, theta double, v double")

    def powers(theta, v):
        return np.array([x for r in powerflow.injections(cells, buses(theta, v)).orderBy("id").collect() for x in (r.p, r.q)])

    theta, v = np.array([0.0, -0.05, -0.1]), np.array([1.0, 0.99, 0.98])
    got = {(r.r, r.c): r.value for r in powerflow.jacobian(cells, buses(theta, v)).collect()}
    y = np.zeros((3, 3), complex)
    for r in cells.collect():
        y[r.i, r.j] = complex(r.re, r.im)
    e = v * np.exp(1j * theta)
    s = e * np.conj(y @ e)
    assert powers(theta, v) == pytest.approx(np.c_[s.real, s.imag].ravel())
    assert {k for k, _ in got} == {2, 4, 5} == {k for _, k in got}  # no voltage of a pv bus, nothing of the slack
    for c in (2, 4, 5):
        d = np.zeros((2, 3))
        d[c % 2, c // 2] = 1e-6
        change = (powers(theta + d[0], v + d[1]) - powers(theta - d[0], v - d[1])) / 2e-6
        assert [got.get((r, c), 0.0) for r in (2, 4, 5)] == pytest.approx(change[[2, 4, 5]].tolist(), abs=1e-6)
    pairs = spark.createDataFrame([(0, 1, 0)], "network_id long, s long, t long")
    flow = powerflow.ptdf(spark.createDataFrame(line(0.001, 0.1)), pairs).first().ptdf
    assert flow == pytest.approx(-1, abs=0.05)


def test_stopping():
    assert stopping.variance([1, 3], 100) == pytest.approx(0.1)
    assert not stopping.StopCriterion([lambda p: [stopping.variance(p, 100)]], [lambda v: v[0]], 0.1).stop([1, 3])
    assert stopping.after(3).stop([0] * 5) and not stopping.after(3).stop([0] * 4)
    steady, c = [1.0] * 60, stopping.mgbm()
    assert any(c.stop(steady[:n]) for n in range(2, 60))


def test_run_loop(spark):
    batch = lambda a, b: spark.range(a, b).select(F.col("id").alias("run_id"), F.lit(1.0).alias("total"))
    assert len(stopping.run_batches(batch, stopping.after(20), least=5, size=8)) == 22


def test_simulation(spark):
    parts = spark.createDataFrame([(i, "node", "PowerGenerator", "power", True, 1.0, 10.0) for i in range(50)] + [(99, "node", "Sink", "gas", True, 1.0, 1.0)], "component_id long, kind string, type string, grid string, independent boolean, coefficient double, nominal double")
    runs = spark.range(20).withColumnRenamed("id", "run_id")
    s = simulation.Settings(steps=32, timesteps=3, shift=0, delay=5, power=50)
    out = simulation.simulate(spark, parts, runs, s)
    failed = out["failures"].toPandas()
    assert 99 not in set(failed.component_id) and (failed.repaired_time >= failed.time + 3).all()
    p = sum(0.1 * 50 * 0.3 * math.exp(-((t - 1.5) ** 2) / 2) / math.sqrt(2 * math.pi) for t in range(3))
    assert abs(len(failed) / 1000 - p) < 0.1
    perf = out["performance"].toPandas()
    assert len(perf) == 20 * 32 and perf.p0.max() > 0 and (perf.p1 == 0).all()
    again = simulation.simulate(spark, parts.repartition(5), runs, s)["performance"].toPandas()
    assert perf.sort_values(["run_id", "step"]).reset_index(drop=True).equals(again.sort_values(["run_id", "step"]).reset_index(drop=True))


def test_cascade_waits_and_repairs(spark):
    rows = [(1, 0, 0, 5, 1.0, 0.0, 0.0), (1, 1, 0, 5, 0.0, 0.0, 0.0)]
    v = spark.createDataFrame(rows, "run_id long, step long, position long, component_id long, violation double, u_fail double, u_duration double")
    assert [(r.step, r.type) for r in cascade.cascade(v).collect()] == [(0, "cascading failure")]
    assert [(r.step, r.type) for r in cascade.cascade(v, early_repair=False).collect()] == [(0, "cascading failure"), (1, "cascading repair")]


def test_vitality_of_networks_in_pieces(spark):
    rows = [(0, 1, 2, 0, 3), (0, 2, 3, 0, 4), (0, 1, 3, 0, 9), (1, 1, 2, 0, 1), (1, 3, 4, 0, 1), (2, 5, 6, 0, 2)]
    vc = {(r.network_id, r.id): r.vc for r in graph.vitality(spark.createDataFrame(rows, "network_id long, u long, v long, key long, w long")).collect()}
    assert {k: v for k, v in vc.items() if k[0] != 1} == {(0, 1): 10.0, (0, 2): 14.0 - 9.0, (0, 3): 11.0, (2, 5): 2.0, (2, 6): 2.0}
    assert all(math.isnan(vc[1, i]) for i in (1, 2, 3, 4))


def test_sources_in_groups(spark):
    path = [(7, i, i + 1, 0, 1) for i in range(50)]
    got = {(r.s, r.t): r.d for r in graph.distances(spark.createDataFrame(path, "network_id long, u long, v long, key long, w long")).collect()}
    assert got == {(a, b): abs(a - b) for a in range(51) for b in range(51) if a != b}


def test_slack_of_a_table(spark):
    rows = [(0, 0, 1, 1, 0.01, 0.1), (0, 1, 2, 2, 0.01, 0.1), (0, 0, 2, 3, 0.01, 0.1)]
    columns = "network_id long, f int, t int, branch long, r double, x double"
    extra = {k: F.lit(0.0) for k in ("g_fr", "b_fr", "g_to", "b_to", "tap", "shift", "theta_i", "theta_j")} | {"vi": F.lit(1.0), "vj": F.lit(1.0)}
    b = spark.createDataFrame(rows, columns).withColumns(extra)
    pairs = spark.createDataFrame([(0, 1, 2)], "network_id long, s long, t long")
    flow = {k: {r.branch: r.ptdf for r in powerflow.ptdf(x, pairs).collect()} for k, x in (("none", b), ("0", b.withColumn("slack", F.lit(0))), ("2", b.withColumn("slack", F.lit(2))))}
    assert flow["none"] == flow["0"] and set(flow["2"]) == {1, 2, 3}
    assert abs(flow["2"][2] - 2 / 3) < 0.05 and flow["2"][2] != flow["0"][2]  # voltages are held at another bus


def test_folders(spark, tmp_path):
    for k, name in enumerate(("n-0-0-3-0-0.5", "n-9-0-3-0-1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "performance.csv").write_text(",0,1,2,id\n0,1.5,2,3,7\n1,NaN,2,3,7\n")
        if not k:
            (tmp_path / name / "failure.csv").write_text(",step,node,type,id\n0,3,a:b:4,failure,7\n")
    perf, fails, repairs = experiments.load(spark, str(tmp_path))
    got = sorted((r.gas_impact, r.cp_density, r.step, r["0"]) for r in perf.collect() if r.power_impact == "0")
    assert got == [("3", 0.5, 0, 1.5)]  # the run's other row lacks a value
    assert perf.count() == 2 and fails.count() == 1 and repairs.count() == 0 and "node" in repairs.columns
    made = []
    for _ in range(2):
        df = experiments.cached(spark, str(tmp_path / "cache"), [perf], lambda: made.append(1) or spark.range(3).toDF("x"))
    assert df.count() == 3 and made == [1]
    (tmp_path / name / "performance.csv").write_text(",0,1,2,id\n0,9.5,2,3,7\n")
    experiments.cached(spark, str(tmp_path / "cache"), [experiments.load(spark, str(tmp_path))[0]], lambda: made.append(1) or spark.range(3).toDF("x"))
    assert made == [1, 1]  # an input was rewritten in place
    perf = experiments.load(spark, str(tmp_path))[0]
    experiments.append(perf.select("experiment", "id"), str(tmp_path / "out"))
    experiments.append(perf.select("experiment", "id"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_profiles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Gas,Heat\n1,10\n2,20\n3,30\n")
    (tmp_path / "b.csv").write_text("Heat,Gas\n5,4\n")
    rows = profiles.read_csv(spark, str(tmp_path / "*.csv"), ["Gas", "Heat"], files=2, steps=8)
    assert sorted((r.hour, r.Gas, r.Heat) for r in rows.collect()) == [(0, 1.0, 10.0), (0, 4.0, 5.0), (1, 2.0, 20.0)]
    assert [r.step for r in profiles.upsample(spark.createDataFrame([(2,)], "hour long")).collect()] == [8, 9, 10, 11]


def test_stacked_bars(spark):
    df = spark.createDataFrame([(k, c, 1.0) for k in range(4) for c in "ab"], "k long, part string, v double")
    got = frames.stacked(df, ["k"], "part", "v", 3).collect()
    assert sorted({r.x for r in got}) == [0.0, 1.0, 2.0, 3.5] and {r.height for r in got} == {2.0} and {r.y_end for r in got} == {2.5}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1, 0), (1, "a", 3, 1), (2, "b", 2, 0)], "run_id long, node string, step long, kind long").write.parquet(src)
    stream = spark.readStream.schema("run_id long, node string, step long, kind long").parquet(src)
    q = faults.component_states(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("states").collect())) == [(1, "a", 1, False), (1, "a", 3, True), (2, "b", 2, False)]


def test_mgbm_asks_after_all_runs(spark, tmp_path):
    totals = [500] * 95 + [510] * 5 + [500] * 30
    c = stopping.mgbm(0.1, 1.0, 100)
    step_by_step = [c.stop([float(x) for x in totals[:n]]) for n in range(2, len(totals) + 1)]
    assert step_by_step[98] and not step_by_step[-1]  # after 100 runs and after all
    for n in (0, 1, 2, 57, 100, 130):
        assert stopping.mgbm_after([float(x) for x in totals[:n]]) == (n > 1 and step_by_step[n - 2])
    rows = [(i, "click", t / 100, 5 * i, datetime.datetime(2024, 1, 1)) for i, t in enumerate(totals)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in QUERIES["mgbm"](spark, str(tmp_path)).collect()] == [(0.0, 130, False)]


def test_networks_as_tables(spark, tmp_path):
    path, schema = str(tmp_path / "nets"), "network_id long, id long, cp_density double"
    networks.write({"nodes": spark.createDataFrame([(1, 5, 0.5), (2, 6, 1.0)], schema)}, path)
    networks.write({"nodes": spark.createDataFrame([(2, 7, 1.0), (2, 8, 1.0)], schema)}, path)
    found = networks.read(spark, path)
    assert list(found) == ["nodes"] and sorted((r.network_id, r.id) for r in found["nodes"].collect()) == [(1, 5), (2, 7), (2, 8)]
    assert networks.read(spark, str(tmp_path / "none")) == {}
    with pytest.raises(ValueError):
        networks.write({"edges": found["nodes"]}, path)
    several = spark.createDataFrame([(3, "b", 0.5), (4, "a", 0.5), (5, "a", None)], "network_id long, path string, cp_density double")
    rows = spark.createDataFrame([("x", 0.5), ("y", 2.0), ("z", None), ("x", 0.5)], "id string, cp_density double")
    assert sorted(((r.id, r.network_id) for r in networks.of_density(rows, several).collect()), key=str) == [("x", 4), ("x", 4), ("y", None), ("z", None)]
    assert experiments.clear(spark, path) and not experiments.clear(spark, path) and networks.read(spark, path) == {}


def test_network_points(spark):
    places = spark.createDataFrame([(0, 1, 1.0, 1.0, "gas", "GasGrid", "Junction", True), (0, 2, 1.0, 1.0, None, "NoGrid", "Control", False), (0, 3, 1.0, 1.0, None, "NoGrid", "Control", True)], "network_id long, id long, x double, y double, grid string, grid_type string, model string, independent boolean")
    values = spark.createDataFrame([(0, 1, 2.5)], "network_id long, id long, value double")
    got = {r.id: (r.x, r.y, r["class"], r.color, r.text) for r in graph.network_points(places, values).collect()}
    assert got == {1: (1.0006, 1.0006, "gas", 2.5, "GasGrid - Junction - 2.5"), 2: (1.0003, 0.9997, "cp", 0.0, "NoGrid - Control - 0.0")}
    assert graph.network_points(places.limit(0), values).count() == 0


def test_residential_demand(spark, tmp_path, caplog):
    components = spark.createDataFrame([(9,), (4,), (6,)], "component_id long")
    for name, rows in (("a", "1,10\n2,20\n3,30"), ("b", "4,5")):
        (tmp_path / f"{name}.csv").write_text("Gas,Heat\n" + rows + "\n")
    got = profiles.residential_demand(spark, str(tmp_path / "*.csv"), ["Heat", "Gas"], components, 8, minus="Gas").collect()
    want = [(4, s, 10.0 if s < 4 else 20.0) for s in range(8)] + [(6, s, 5.0) for s in range(4)]
    assert sorted(map(tuple, got)) == want
    noise = profiles.residential_demand(spark, str(tmp_path / "*.none"), ["Heat"], components, 8, seed=3).collect()
    assert len(noise) == 24 and any(r.value < 0 for r in noise) and "random ones" in caplog.text
    stored = str(tmp_path / "series")
    spark.createDataFrame([(1, 0, 2.0)], "component_id long, step int, value double").write.parquet(stored)
    assert profiles.absolute_profiles(spark, stored).count() == 1
    spark.createDataFrame([], "component_id long, step int, value double").write.mode("overwrite").parquet(stored)
    with pytest.raises(ValueError):
        profiles.absolute_profiles(spark, stored)


def test_names_and_titles(spark):
    assert one(spark, scalar.legacy_id(F.lit("n"), F.lit("Bus"), F.lit(3))) == "n:Bus:3"
    titles = F.array(F.lit("a"), F.lit(None))
    assert [one(spark, scalar.title_or(titles, i, F.lit("z"))) for i in range(3)] == ["a", "z", "z"]
