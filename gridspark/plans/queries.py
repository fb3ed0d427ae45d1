"""One query for each operator, over tables made from the driver's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import rng, scalar
from gridspark.operators import cascade, components, frames, graph, kalman, numbering, powerflow, rollup, simulation, stopping, temporal, walks
from gridspark.operators import impact as im
from gridspark.plans import evaluation
from gridspark.plans import fixtures as fx
from gridspark.sources import experiments, folders, networks, profiles
from gridspark.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SETTINGS = simulation.Settings(seed=101, steps=32, timesteps=3, shift=0, delay=5, power=50, heat=50, gas=50, mes=50)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(c: str, digits: int) -> Column:
    """Rounded, without negative zeros."""
    x = F.round(c, digits)
    return F.when(x == 0, 0.0).otherwise(x)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return im.fault_pairs(fx.faults(s, d, "failure"), fx.faults(s, d, "repair"))


def _impact(s: SparkSession, d: str) -> DataFrame:
    return im.impact(fx.perf(s, d), _pairs(s, d), fx.components(s), fx.CENTS, 100.0)


def _milli(s: SparkSession, d: str) -> DataFrame:
    """Impacts in whole thousandths, whose sums are the same in every order."""
    return im.typed(_impact(s, d)).withColumn("impact", F.round(F.col("impact") * 1000).cast("long"))


@query
def scan_annotate(s: SparkSession, d: str) -> DataFrame:
    runs = fx.perf(s, d).select("experiment", "id").distinct()
    return experiments.annotate(runs, F.col("experiment"))


@query
def folder_scan(s: SparkSession, d: str) -> DataFrame:
    """Rows of the folders of three densities and some impacts; the others are not read."""
    path = fx.result_folders(s, d)
    found = folders.load(s, path, "performance").where("cp_density >= 1.0 and power_impact <> '5'")
    return found.groupBy("experiment", "heat_impact", "cp_density").agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(c) for c in fx.CENTS.values()))


@query
def folder_faults(s: SparkSession, d: str) -> DataFrame:
    path = fx.result_folders(s, d)
    return im.fault_pairs(folders.load(s, path, "failure"), folders.load(s, path, "repair")).drop("experiment")


@query
def folder_rollups(s: SparkSession, d: str) -> DataFrame:
    """From files of results to rollups of impacts."""
    return evaluation.evaluate(s, fx.result_folders(s, d), fx.components(s), scale=100.0)["rollups"]


@query
def component_key(s: SparkSession, d: str) -> DataFrame:
    names = fx.faults(s, d, "failure").select("node").distinct()
    return names.select("node", scalar.component_kind(F.col("node")).alias("kind"), scalar.component_key(F.col("node")).alias("key"))


@query
def failure_repair_pairs(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d)


@query
def interval_inside(s: SparkSession, d: str) -> DataFrame:
    return im.inside(fx.perf(s, d), _pairs(s, d))


@query
def interval_outside(s: SparkSession, d: str) -> DataFrame:
    rows = im.outside(fx.perf(s, d), _pairs(s, d), fx.components(s))
    return rows.groupBy("cp_density", "node").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in fx.CENTS.values()))


@query
def impact_subtraction(s: SparkSession, d: str) -> DataFrame:
    return _impact(s, d)


@query
def interval_sums(s: SparkSession, d: str) -> DataFrame:
    return im.interval_sums(fx.perf(s, d), _pairs(s, d), list(fx.CENTS.values()))


@query
def impact_running(s: SparkSession, d: str) -> DataFrame:
    return im.impact_by_running_sums(fx.perf(s, d), _pairs(s, d), fx.components(s), fx.CENTS, 100.0)


@query
def impact_naive(s: SparkSession, d: str) -> DataFrame:
    """Impact of electricity by the plain complement, which impact_subtraction must equal."""
    p, pairs, nodes = fx.perf(s, d), _pairs(s, d), fx.components(s)
    mean = lambda df, name: df.groupBy("cp_density", "node").agg((F.sum("c0") / (F.count("c0") * F.lit(100.0))).alias(name))
    both = nodes.join(mean(im.inside(p, pairs), "i"), ["cp_density", "node"], "left").join(mean(im.outside(p, pairs, nodes), "o"), ["cp_density", "node"], "left")
    return both.select("cp_density", "node", scalar.impact_ratio(F.col("i"), F.col("o")).alias("impact"))


@query
def scenario_resilience(s: SparkSession, d: str) -> DataFrame:
    return im.scenario_resilience(fx.perf(s, d), fx.CENTS, 100.0)


@query
def run_total(s: SparkSession, d: str) -> DataFrame:
    return im.run_total(fx.perf(s, d), list(fx.CENTS.values()))


@query
def impact_children(s: SparkSession, d: str) -> DataFrame:
    return im.children_impact(_milli(s, d).drop("type"), fx.members(s))


@query
def impact_extended(s: SparkSession, d: str) -> DataFrame:
    own = _milli(s, d).drop("type_carrier").withColumn("impact", F.col("impact").cast("double"))
    return im.extended_impact(own, fx.members(s))


def _rollup(name: str, how: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return rollup.rollup(_milli(s, d), name, how)

    return run


for _name in rollup.ROLLUPS:
    for _how in ("mean", "sum"):
        QUERIES[f"rollup_{_name}_{_how}"] = _rollup(_name, _how)


@query
def rollup_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return rollup.all_rollups(_milli(s, d))


def _joined(s: SparkSession, d: str) -> DataFrame:
    return rollup.with_metrics(_milli(s, d).drop("type_carrier"), fx.metrics(s))


@query
def metric_impact_join(s: SparkSession, d: str) -> DataFrame:
    return _joined(s, d)


@query
def metric_impact_all(s: SparkSession, d: str) -> DataFrame:
    return rollup.over_carriers(_joined(s, d))


@query
def type_groups(s: SparkSession, d: str) -> DataFrame:
    return rollup.by_type_group(_joined(s, d)).groupBy("type_group", "carrier").agg(F.count("*").alias("n"), F.sum("impact").alias("impact"))


@query
def metric_impact_frame(s: SparkSession, d: str) -> DataFrame:
    return rollup.metric_impact_frame(_joined(s, d))


def _sparse(s: SparkSession, d: str) -> DataFrame:
    """Losses that are only known at every third step."""
    p = fx.perf(s, d)
    every = temporal.spine(p.select("id").distinct(), 30).withColumn("step", F.col("step").cast("long"))
    known = p.groupBy("id", "step").agg(F.sum("c0").alias("c0")).where("step % 3 = 0")
    return every.join(known, ["id", "step"], "left")


@query
def locf_performance(s: SparkSession, d: str) -> DataFrame:
    return temporal.carried_forward(_sparse(s, d), ["id"], ["c0"])


@query
def padded_series(s: SparkSession, d: str) -> DataFrame:
    p = fx.perf(s, d).select("id", F.col("step").cast("int").alias("step"), "c0")
    return temporal.padded(p, p, ["id"], 30, 0)


def _moves(s: SparkSession, d: str) -> DataFrame:
    both = fx.faults(s, d, "failure").unionByName(fx.faults(s, d, "repair"))
    return both.select("id", F.col("node"), F.col("step").cast("int").alias("step"), F.col("event_id").alias("position"), F.when(F.col("type") == "failure", 0).otherwise(1).alias("kind"))


@query
def fault_state(s: SparkSession, d: str) -> DataFrame:
    return temporal.fault_states(_moves(s, d), ["id"], 30)


@query
def state_intervals(s: SparkSession, d: str) -> DataFrame:
    return temporal.state_intervals(_moves(s, d), ["id"], 30)


@query
def states_at_changes(s: SparkSession, d: str) -> DataFrame:
    """States of all components at the steps at which something has to be solved."""
    m = _moves(s, d)
    return temporal.states_at(temporal.state_intervals(m, ["id"], 30), temporal.change_steps(m, ["id"]), ["id"])


@query
def change_steps(s: SparkSession, d: str) -> DataFrame:
    return temporal.change_steps(_moves(s, d), ["id"])


@query
def upsample(s: SparkSession, d: str) -> DataFrame:
    return profiles.upsample(fx.hourly(s, d))


@query
def prefix_rows(s: SparkSession, d: str) -> DataFrame:
    return profiles.first_rows(fx.hourly(s, d), "profile", "hour", 8)


@query
def profile_demand(s: SparkSession, d: str) -> DataFrame:
    wide = fx.hourly(s, d).groupBy("hour").pivot("profile", ["F", "O", "P"]).agg(F.sum("kw")).fillna(0)
    return wide.select("hour", profiles.demand([F.col("F"), F.col("O")], F.col("P")).alias("kw"))


@query
def profile_scale(s: SparkSession, d: str) -> DataFrame:
    h = fx.hourly(s, d)
    return h.select("profile", "hour", profiles.heat_demand(F.col("kw")).alias("heat"), profiles.gas_demand(F.col("kw"), 54.0).alias("gas"))


@query
def positional_profile(s: SparkSession, d: str) -> DataFrame:
    targets = fx.hazard_components(s, d).where("type = 'PowerGenerator'").orderBy("component_id").limit(3).select("component_id", (F.col("component_id") + 1).alias("nominal"))
    series = fx.hourly(s, d).withColumnRenamed("kw", "value").withColumn("o", F.col("profile"))
    return profiles.scaled(profiles.attach_by_position(series, targets, "o", "component_id"), "nominal").select("component_id", "profile", "hour", "value")


@query
def random_profile(s: SparkSession, d: str) -> DataFrame:
    out = profiles.random_profile(fx.hazard_components(s, d).where("type = 'Source'"), 4, 101, absolute=True)
    return out.select("component_id", "step", F.round("value", 9).alias("value"))


@query
def random_demand(s: SparkSession, d: str) -> DataFrame:
    c = fx.hazard_components(s, d)
    out = profiles.random_demand(c.where("grid = 'power'"), c.where("grid = 'water'"), c.where("grid = 'gas'"), 4, 101)
    return out.withColumn("value", F.round("value", 9))


@query
def profile_sum(s: SparkSession, d: str) -> DataFrame:
    h = fx.hourly(s, d)
    return profiles.merged([h, h.where("kw % 2 = 0").withColumn("kw", F.col("kw") * 2)], ["profile", "hour"], "kw")


@query
def hazard_prob(s: SparkSession, d: str) -> DataFrame:
    t = simulation.trials(fx.hazard_components(s, d), fx.runs(s), SETTINGS)
    return t.select("run_id", "component_id", "time", F.round("probability", 9).alias("probability"))


@query
def failures(s: SparkSession, d: str) -> DataFrame:
    return simulation.failures(fx.hazard_components(s, d), fx.runs(s), SETTINGS).select("run_id", "component_id", "time", F.round("severity", 9).alias("severity"), "effect")


def _repaired(s: SparkSession, d: str) -> DataFrame:
    return simulation.repairs(simulation.failures(fx.hazard_components(s, d), fx.runs(s), SETTINGS), SETTINGS)


@query
def repairs(s: SparkSession, d: str) -> DataFrame:
    return _repaired(s, d).select("run_id", "component_id", "time", F.round("damage", 9).alias("damage"), "repaired_time")


@query
def event_log(s: SparkSession, d: str) -> DataFrame:
    return simulation.events(_repaired(s, d), SETTINGS.steps)


@query
def simulated_performance(s: SparkSession, d: str) -> DataFrame:
    p = simulation.simulate(s, fx.hazard_components(s, d), fx.runs(s), SETTINGS)["performance"]
    return p.select("run_id", "step", *(F.round(c, 4).alias(c) for c in ("p0", "p1", "p2")))


@query
def violation_prob(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value") / 100
    e = fx.table(s, d, "events").select("event_id", scalar.relative_violation(v, F.lit(1.0), F.lit(0.1)).alias("violation"))
    return e.select("event_id", F.round("violation", 9).alias("violation"), F.round(scalar.violation_probability(F.col("violation")), 6).alias("probability"))


@query
def cascade_events(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events").select(F.col("user_id").alias("run_id"), (F.dayofmonth("ts") - 1).cast("long").alias("step"), F.col("event_id").alias("position"), (F.col("event_id") % 20).alias("component_id"), F.greatest(F.col("value") / 1000 - 0.1, F.lit(0.0)).alias("violation"), rng.uniform("f", F.col("event_id")).alias("u_fail"), rng.uniform("d", F.col("event_id")).alias("u_duration"))
    return cascade.cascade(e.where("violation is not null"))


@query
def load_components(s: SparkSession, d: str) -> DataFrame:
    n = F.col("component_id")
    kind = F.element_at(F.array(*map(F.lit, fx.TYPES)), (n % 20 + 1).cast("int"))
    c = fx.hazard_components(s, d).withColumn("type", kind)
    return c.select("component_id", "type", F.coalesce(scalar.is_load(F.col("type"), F.col("grid")), F.lit(False)).alias("is_load"), (~F.col("independent")).alias("dependent"), scalar.plot_class(F.col("type"), F.col("independent")).alias("plot_class")).where("is_load or dependent")


@query
def eligible_components(s: SparkSession, d: str) -> DataFrame:
    return simulation.eligible(fx.hazard_components(s, d)).groupBy("kind", "type").agg(F.count("*").alias("n"))


@query
def balance(s: SparkSession, d: str) -> DataFrame:
    g = fx.table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("run_id"), F.when(F.col("s_suppkey") % 2 == 0, "ExtPowerGrid").otherwise("ExtHydrGrid").alias("type"), F.round(F.col("s_acctbal") * 100).cast("long").alias("v"))
    return simulation.balance(g, ["run_id"], F.col("v"))


@query
def node_deactivation(s: SparkSession, d: str) -> DataFrame:
    f = fx.faults(s, d, "failure").select("cp_density", "id", "step", scalar.component_key(F.col("node")).alias("node"))
    m = fx.members(s).where("cp_density = 0").select("node", "child")
    return simulation.deactivate_nodes(f, m).groupBy("node").agg(F.count("*").alias("n"))


@query
def experiment_sweep(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id") + 1
    a, b = scalar.experiment_choice(n, 3, 5)
    return s.range(300).select(n.alias("run_number"), a.alias("impact_no"), b.alias("density_no"), scalar.run_id(n, F.lit(7)).alias("run_id"), scalar.experiment_name("x", a, b, a, b, b / 2.0).alias("folder"))


@query
def failure_text(s: SparkSession, d: str) -> DataFrame:
    c = fx.hazard_components(s, d)
    k = F.col("component_id")
    text = scalar.failure_text(k % 3, k % 7, F.lit(1), F.lit(0), F.coalesce("grid", F.lit("none")), F.col("type"), k)
    return c.select("component_id", text.alias("failure"), scalar.fault_text(F.lit("component"), k % 3, k % 7).alias("fault"), scalar.slug(F.concat(F.lit("<b>a/"), k.cast("string"))).alias("slug"))


@query
def component_values(s: SparkSession, d: str) -> DataFrame:
    """Numbers and names that are read off a component, its bounds, losses and shortest outage."""
    k, c = F.col("component_id"), fx.hazard_components(s, d)
    grid = F.coalesce("grid", F.lit("heat"))
    low, high = scalar.bounds(F.col("nominal"), k % 10 / 100.0)
    values = {
        "number": scalar.key_number(F.concat(F.lit("node:"), k.cast("string"))),
        "class": scalar.short_class_name(F.concat(F.lit("<class 'grid.model."), "type", F.lit("'>"))),
        "legacy": scalar.legacy_id(k % 3, F.col("kind"), k),
        "title": scalar.title_or(F.array(F.when(k % 2 == 0, F.lit("even"))), 0, F.lit("untitled")),
        "low": F.round(low, 6),
        "high": F.round(high, 6),
        "mw": F.round(scalar.mass_flow_to_mw(k / 10.0), 6),
        "loss": scalar.edge_loss(F.when(grid == "water", "heat").otherwise("gas"), F.array(k * 2, k * 3)),
        "duration": scalar.minimum_duration(rng.uniform("p", k), rng.uniform("u", k)),
    }
    return c.select("component_id", *(v.alias(n) for n, v in values.items()))


@query
def degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degree(fx.edges(s, d))


@query
def edge_degree(s: SparkSession, d: str) -> DataFrame:
    e = fx.edges(s, d)
    return graph.over_ends(e, graph.degree(e), "degree", "sum")


@query
def apsp(s: SparkSession, d: str) -> DataFrame:
    return graph.distances(fx.edges(s, d)).select("s", "t", "d")


@query
def betweenness(s: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(fx.edges(s, d)).select("id", F.round("betweenness_centrality", 9).alias("bc"))


@query
def edge_betweenness(s: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness(fx.edges(s, d)).select("u", "v", F.round("betweenness_centrality", 9).alias("bc"))


@query
def vitality(s: SparkSession, d: str) -> DataFrame:
    return graph.vitality(fx.edges(s, d)).select("id", "vc")


@query
def katz(s: SparkSession, d: str) -> DataFrame:
    return graph.katz(fx.edges(s, d), scale=100000.0).select("id", F.round("katz", 9).alias("katz"))


def _groups(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(0, 1, "CHP", {"a": 1, "b": 2}, [1, 2]), (0, 2, "PowerToHeat", {"a": 3, "b": 4, "c": 5}, [3, 4, 5])], "network_id long, id long, type string, connected_to map<string,long>, members array<long>")


@query
def group_betweenness(s: SparkSession, d: str) -> DataFrame:
    g = _groups(s).select("network_id", F.col("id").alias("group_id"), "members")
    return graph.group_betweenness(fx.edges(s, d), g).select("group_id", F.round("betweenness_centrality", 9).alias("bc"))


@query
def metrics_table(s: SparkSession, d: str) -> DataFrame:
    children = s.range(10).select(F.lit(0).cast("long").alias("network_id"), "id", F.col("id").alias("node_id"), F.lit("PowerLoad").alias("type"))
    return graph.metrics_table(fx.edges(s, d), children, _groups(s), 100000.0).select("id", "type", "degree", *(F.round(c, 9).alias(c) for c in ("betweenness_centrality", "vc", "katz")))


@query
def grid_edges(s: SparkSession, d: str) -> DataFrame:
    return fx.grids(s, d)


@query
def grid_measures(s: SparkSession, d: str) -> DataFrame:
    """Betweenness and vitality of the nodes of all regions' networks, from one walk."""
    out = graph.of_nodes(walks.walk(fx.grids(s, d)))
    return out.select("network_id", "id", F.round("betweenness_centrality", 9).alias("bc"), "vc")


@query
def grid_katz(s: SparkSession, d: str) -> DataFrame:
    return graph.katz(fx.grids(s, d), scale=5000.0).select("network_id", "id", F.round("katz", 9).alias("katz"))


@query
def grid_group_betweenness(s: SparkSession, d: str) -> DataFrame:
    g = fx.grid_compounds(s, d).select("network_id", F.col("id").alias("group_id"), "members")
    return graph.group_betweenness(fx.grids(s, d), g).select("network_id", "group_id", F.round("betweenness_centrality", 9).alias("bc"))


@query
def grid_metrics(s: SparkSession, d: str) -> DataFrame:
    """All metrics of all networks, with the density of each."""
    out = graph.metrics_table(fx.grids(s, d), fx.grid_children(s, d), fx.grid_compounds(s, d), 5000.0)
    return out.select((F.col("network_id") * 0.5).alias("cp_density"), "id", "type", "degree", *(F.round(c, 9).alias(c) for c in ("betweenness_centrality", "vc", "katz")))


@query
def network_frame(s: SparkSession, d: str) -> DataFrame:
    e = fx.edges(s, d)
    places = graph.nodes(e).select("network_id", "id", (F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"))
    values = e.where("w % 2 = 0").select("network_id", "u", "v", "key", F.col("w").cast("double").alias("value"))
    return graph.network_frame(e, places, values).drop("network_id", "key")


@query
def color_range(s: SparkSession, d: str) -> DataFrame:
    """Colours of nodes and edges of the regions' charts on one scale."""
    e = fx.grids(s, d)
    return frames.color_range([graph.degree(e).withColumnRenamed("degree", "color"), e.withColumnRenamed("w", "color")], ["network_id"])


@query
def network_points(s: SparkSession, d: str) -> DataFrame:
    n, i = graph.nodes(fx.edges(s, d)).select("network_id", "id"), F.col("id")
    grid = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % 4 + 1).cast("int"))
    places = n.select("*", (i % 5).cast("double").alias("x"), F.floor(i / 5).cast("double").alias("y"), grid(("power", "heat", "gas", "None")).alias("grid"), grid(("PowerGrid", "WaterGrid", "GasGrid", "NoGrid")).alias("grid_type"), F.when(i % 4 == 0, "Bus").otherwise("Junction").alias("model"), (i % 6 != 3).alias("independent"))
    return graph.network_points(places, n.where("id % 2 = 0").withColumn("value", i / 4)).drop("network_id")


@query
def density_network(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    found = fx.table(s, d, "supplier").select(k.cast("long").alias("network_id"), F.col("s_name").alias("path"), ((k % 4) * 0.5).cast("double").alias("cp_density"))
    return networks.of_density(fx.metrics(s).select("id", "cp_density"), found)


@query
def densities(s: SparkSession, d: str) -> DataFrame:
    return rollup.densities(fx.perf(s, d))


@query
def ybus(s: SparkSession, d: str) -> DataFrame:
    return powerflow.admittance(fx.branches(s, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query
def line_flow(s: SparkSession, d: str) -> DataFrame:
    return powerflow.line_flow(fx.branches(s, d)).select("branch", F.round("p_from", 6).alias("p_from"))


@query
def ptdf(s: SparkSession, d: str) -> DataFrame:
    pairs = s.createDataFrame([(0, 1, 2), (0, 3, 0)], "network_id long, s long, t long")
    return powerflow.ptdf(fx.branches(s, d), pairs).withColumn("ptdf", _rounded("ptdf", 9))


@query
def jacobian_sv(s: SparkSession, d: str) -> DataFrame:
    return powerflow.singular_values(fx.branches(s, d))


@query
def grid_injections(s: SparkSession, d: str) -> DataFrame:
    used, buses = fx.grid_power(s, d)
    return powerflow.injections(powerflow.admittance(used), buses).select("network_id", "id", _rounded("p", 6).alias("p"), _rounded("q", 6).alias("q"))


@query
def grid_jacobian(s: SparkSession, d: str) -> DataFrame:
    used, buses = fx.grid_power(s, d)
    return powerflow.jacobian(powerflow.admittance(used), buses).withColumn("value", _rounded("value", 6))


@query
def grid_ptdf(s: SparkSession, d: str) -> DataFrame:
    e = fx.grids(s, d)
    used, buses = fx.grid_power(s, d, e)
    return powerflow.ptdf(used, fx.grid_transfers(s, d, e), buses).withColumn("ptdf", _rounded("ptdf", 6))


@query
def transfer_residual(s: SparkSession, d: str) -> DataFrame:
    e = fx.grids(s, d)
    used, buses = fx.grid_power(s, d, e)
    cells, transfers = stored(powerflow.jacobian(powerflow.admittance(used), buses), "cells"), fx.grid_transfers(s, d, e)
    return powerflow.residual(cells, transfers, powerflow.increments(cells, transfers)).withColumn("residual", F.round("residual", 6))


@query
def grid_singular_values(s: SparkSession, d: str) -> DataFrame:
    out = powerflow.extreme_singular_values(*fx.grid_power(s, d))
    return out.select("network_id", F.round("largest", 6).alias("largest"), F.round("smallest", 6).alias("smallest"))


def _totals(s: SparkSession, d: str) -> DataFrame:
    return im.run_total(fx.perf(s, d), list(fx.CENTS.values()))


@query
def variance_indicator(s: SparkSession, d: str) -> DataFrame:
    out = stopping.variance_indicator(_totals(s, d), ["cp_density"], "id", "total", 100)
    return out.select("cp_density", F.round(F.col("indicator") / 1e6, 4).alias("indicator"))


@query
def iteration_stop(s: SparkSession, d: str) -> DataFrame:
    return stopping.threshold_decision(stopping.iteration_indicator(_totals(s, d), ["cp_density"]), ["cp_density"], 20, reverse=True)


@query
def mgbm(s: SparkSession, d: str) -> DataFrame:
    """Whether the criterion would stop, for each density, after all its runs."""
    import pandas as pd

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        totals = rows.sort_values("id").total.to_numpy(float)
        return pd.DataFrame({"cp_density": [rows.cp_density.iloc[0]], "runs": [len(totals)], "stop": [stopping.mgbm_after(totals, 0.1, 1.0, 100)]})

    return _totals(s, d).groupBy("cp_density").applyInPandas(decide, "cp_density double, runs long, stop boolean")


@query
def kalman_smooth(s: SparkSession, d: str) -> DataFrame:
    """Totals of a density's runs (in hundreds), smoothed in blocks of eight runs."""
    rank = F.row_number().over(Window.partitionBy("cp_density").orderBy("id", "experiment")) - 1
    series = _totals(s, d).select("cp_density", rank.alias("t"), (F.col("total") / 10000.0).alias("y"))
    params = series.select("cp_density").distinct().select("cp_density", F.lit(0.5).alias("q"), F.lit(2.0).alias("r"), F.lit(0.0).alias("m0"), F.lit(1.0).alias("p0"))
    out = kalman.smoothed(series, params, ["cp_density"], block=8)
    return out.select("cp_density", "t", *(F.round(c, 6).alias(c) for c in ("mean", "var", "change")))


@query
def grouped_hist(s: SparkSession, d: str) -> DataFrame:
    return frames.grouped_histogram(_milli(s, d).where("impact is not null"), "type", "impact", "carrier")


@query
def multilevel_bar(s: SparkSession, d: str) -> DataFrame:
    r = fx.perf(s, d).groupBy("cp_density", "experiment").agg(*(F.sum(c).alias(c) for c in fx.CENTS.values()))
    long = r.unpivot(["cp_density", "experiment"], list(fx.CENTS.values()), "carrier", "loss")
    return frames.stacked(long, ["cp_density", "experiment"], "carrier", "loss", 3)


@query
def multi_bar(s: SparkSession, d: str) -> DataFrame:
    p = fx.perf(s, d).groupBy("cp_density").agg(*(F.sum(c).alias(k) for k, c in fx.CENTS.items()))
    return frames.multi_bar(p, "cp_density", list(fx.CENTS))


@query
def wide_profiles(s: SparkSession, d: str) -> DataFrame:
    return frames.wide(fx.hourly(s, d), ["hour"], "profile", "kw", ["F", "O", "P"])


@query
def external_grids(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    g = fx.table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("network_id"), k.alias("id"), F.when(k % 2 == 0, "ExtPowerGrid").otherwise("ExtHydrGrid").alias("type"), F.round(F.col("s_acctbal") * 100).cast("long").alias("v"))
    return components.grid_balance(g, "v")


@query
def relevant_components(s: SparkSession, d: str) -> DataFrame:
    n = F.col("component_id")
    c = fx.hazard_components(s, d).withColumn("type", F.element_at(F.array(*map(F.lit, fx.TYPES)), (n % 20 + 1).cast("int"))).select(F.lit(0).alias("network_id"), n.alias("id"), "type", "grid", "kind")
    return components.relevant(c.where("kind = 'child'"), c.where("kind = 'branch'")).select("id", "type", "kind")


@query
def numbered_orders(s: SparkSession, d: str) -> DataFrame:
    """The place of every order by price and key."""
    o = fx.table(s, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return numbering.numbered(o, ["cents", "o_orderkey"], "place")


@query
def line_frame(s: SparkSession, d: str) -> DataFrame:
    p = fx.perf(s, d).groupBy("step").agg(*(F.sum(c).alias(c) for c in fx.CENTS.values()))
    return frames.series(p, "step", list(fx.CENTS.values()))


def entry(s: SparkSession, d: str) -> DataFrame:
    return impact_subtraction(s, d).orderBy("cp_density", "node", "carrier")


