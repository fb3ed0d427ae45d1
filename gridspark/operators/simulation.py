"""Failures, repairs and their events, and whole runs, as one plan keyed by run; nothing depends on partitions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import fixed, rng
from gridspark.functions.scalar import component_name, failure_probability, lookup, repair_duration
from gridspark.operators import temporal


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the failure and repair models."""

    seed: int = 101
    steps: int = 96
    timesteps: int = 10
    shift: int = 5
    delay: float = 10
    power: float = 5
    heat: float = 0.1
    gas: float = 0.1
    mes: float = 1
    base_fail: float = 0.3


def eligible(components: DataFrame) -> DataFrame:
    """Components that fail by themselves: independent ones, heat exchangers and all compounds."""
    own = F.col("independent") | (F.col("kind") == "compound") | ((F.col("kind") == "branch") & (F.col("type") == "HeatExchanger"))
    return components.where(F.coalesce(own, F.lit(False)))


def trials(components: DataFrame, runs: DataFrame, s: Settings) -> DataFrame:
    """run_id, component, time, probability of every trial."""
    grid = eligible(components).crossJoin(runs.select("run_id")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(s.timesteps - 1))))
    time = F.col("i") + s.shift
    noise = rng.normal(1.0, 0.1, s.seed, F.col("run_id"), F.col("i"), F.col("component_id"), "p")
    p = failure_probability(F.col("type"), F.col("grid"), time, noise, timesteps=s.timesteps, shift=s.shift, power=s.power, heat=s.heat, gas=s.gas, mes=s.mes, base_fail=s.base_fail)
    return grid.withColumn("time", time).withColumn("probability", p)


def failures(components: DataFrame, runs: DataFrame, s: Settings) -> DataFrame:
    """Trials that come true; the severity is the probability, the effect 0 (dead)."""
    u = rng.uniform(s.seed, F.col("run_id"), F.col("i"), F.col("component_id"), "u")
    hit = trials(components, runs, s).where(u < F.col("probability"))
    return hit.select("run_id", "component_id", "kind", "type", "coefficient", "time", F.col("probability").alias("severity"), F.lit(0).alias("effect"))


def repairs(failed: DataFrame, s: Settings) -> DataFrame:
    """Failures with damage and the step of their repair.  A type without a damage coefficient raises."""
    constant = lookup(fixed.DAMAGE_ATTRIBUTE, F.col("type"))
    coefficient = F.when(constant.isNull(), F.raise_error(F.concat(F.lit("no damage coefficient for "), F.col("type")))).when(constant == "1", 1.0).otherwise(F.col("coefficient"))
    key = (s.seed, F.col("run_id"), F.col("time"), F.col("component_id"))
    damage = coefficient * rng.normal(1.0, 0.1, *key, "d") * F.col("severity")
    out = failed.withColumn("damage", damage)
    duration = repair_duration(F.col("damage"), s.delay, rng.normal(5.0, 5.0, *key, "r"), s.timesteps)
    return out.withColumn("repaired_time", (F.col("time") + duration).cast("int"))


def events(repaired: DataFrame, steps: int) -> DataFrame:
    """A failure row at the start and a repair row at the stop of each fault, as far as the horizon goes."""
    both = F.array(F.struct(F.col("time").alias("step"), F.lit("failure").alias("type")), F.struct(F.col("repaired_time").alias("step"), F.lit("repair").alias("type")))
    name = component_name(F.concat(F.col("kind"), F.lit("-"), F.col("component_id").cast("string")), F.col("type"), F.col("component_id"))
    return repaired.select("run_id", name.alias("node"), "component_id", F.explode(both).alias("e")).select("run_id", "component_id", "node", "e.step", "e.type").where(F.col("step") < steps)


def unserved_load(components: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A stand-in for a solver: the rated load of the inactive components of a step, by carrier."""

    def model(states: DataFrame) -> DataFrame:
        rated = components.select("component_id", "grid", F.abs("nominal").alias("load"))
        lost = states.where("not active").join(rated, "component_id")
        pick = lambda *g: F.coalesce(F.sum(F.when(F.col("grid").isin(*g), F.col("load"))), F.lit(0.0))
        return lost.groupBy("run_id", "step").agg(pick("power").alias("p0"), pick("water", "heat").alias("p1"), pick("gas").alias("p2"))

    return model


def simulate(spark: SparkSession, components: DataFrame, runs: DataFrame, s: Settings = Settings(), performance: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Failures, events and performance (p0, p1, p2 by run and step) of all runs.

    performance gets the states (run_id, component_id, step, active) at the steps where something changes;
    between them the last values hold.
    """
    repaired = repairs(failures(components, runs, s), s)
    log = events(repaired, s.steps)
    moves = log.select("run_id", F.col("component_id").alias("node"), "step", F.col("component_id").alias("position"), F.when(F.col("type") == "failure", 0).otherwise(1).alias("kind"))
    states = temporal.fault_states(moves, ["run_id"], s.steps).withColumnRenamed("node", "component_id")
    solve = temporal.change_steps(moves, ["run_id"])
    solved = (performance or unserved_load(components))(states.join(solve, ["run_id", "step"]))
    values = ["p0", "p1", "p2"]
    known = solve.join(solved, ["run_id", "step"], "left").fillna(0.0, values)
    every = temporal.spine(runs.select("run_id"), s.steps).join(known, ["run_id", "step"], "left")
    return {"failures": repaired, "events": log, "performance": temporal.carried_forward(every, ["run_id"], values).fillna(0.0, values)}


def sweep(spark: SparkSession, impacts: list[tuple[float, float, float, float]], densities: list[float], n_runs: int) -> DataFrame:
    """Every impact tuple (power, gas, heat, mes) with every density, and runs numbered within each."""
    a = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(impacts)], "impact_no int, power double, gas double, heat double, mes double")
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate(densities)], "density_no int, cp_density double")
    return a.crossJoin(b).crossJoin(spark.range(n_runs).withColumnRenamed("id", "run_no"))


def balance(components: DataFrame, run: list[str], values: Column) -> DataFrame:
    """What external grids feed in: power grids first, hydro grids second, as sums per run."""
    grids = components.where(F.col("type").isin("ExtPowerGrid", "ExtHydrGrid"))
    return grids.groupBy(*run).agg(F.sum(F.when(F.col("type") == "ExtPowerGrid", values)).alias("p_mw"), F.sum(F.when(F.col("type") == "ExtHydrGrid", values)).alias("mass_flow"))


def deactivate_nodes(faults: DataFrame, members: DataFrame) -> DataFrame:
    """Faults of nodes reach their children too."""
    return faults.unionByName(faults.join(members, "node").select(*(F.col("child").alias("node") if c == "node" else c for c in faults.columns)))
