"""Scalar expressions on columns: component ids, probabilities, damage, impact, units."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions import fixed


def lookup(table: Mapping[str, object], key: Column, default: object = None) -> Column:
    """The table's value for a key, or the default."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def component_kind(name: Column) -> Column:
    """compound, child, branch or node; the first test that holds decides, so a coupling's child is a compound."""
    return F.when(name.contains("CHP") | name.contains("PowerToHeat"), "compound").when(name.contains(".child."), "child").when(name.endswith(")"), "branch").otherwise("node")


def component_key(name: Column) -> Column:
    return F.concat(component_kind(name), F.lit(":"), F.element_at(F.split(name, ":"), -1))


def component_name(name: Column, model: Column, ident: Column) -> Column:
    return F.concat_ws(":", name, model, ident.cast("string"))


def key_number(key: Column) -> Column:
    """The number of a node:n or child:n key."""
    return F.split(key, ":")[1].cast("long")


def short_class_name(text: Column) -> Column:
    """The last part of a dotted class, with or without the closing quote and bracket."""
    return F.regexp_extract(text, r"([A-Za-z0-9_]+)(?:'>)?$", 1)


def slug(text: Column) -> Column:
    return F.translate(text, "/<>", "")


def scenario_key(experiment: Column) -> Column:
    """Impacts of a path a/b/name-p-h-g-m-density: its third part without first and last field."""
    parts = F.split(F.split(experiment, "/")[2], "-")
    return F.array_join(F.slice(parts, 2, F.size(parts) - 2), "-")


def scenario_label(key: Column) -> Column:
    return F.coalesce(lookup(fixed.SCENARIO, key), key)


def experiment_name(prefix: str, power: Column, heat: Column, gas: Column, mes: Column, density: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), *(c.cast("string") for c in (power, heat, gas, mes, density)))


def experiment_choice(number: Column, impacts: int, densities: int) -> tuple[Column, Column]:
    """Which impact tuple and which density the run of a number has."""
    at = number - 1
    return (at % impacts).cast("int"), (F.floor(at / impacts) % densities).cast("int")


def run_id(process: Column, i: Column) -> Column:
    return process * fixed.RUNS_PER_PROCESS + i


def failure_text(time: Column, repaired: Column, severity: Column, effect: Column, grid: Column, model: Column, ident: Column) -> Column:
    return F.concat(time.cast("string"), F.lit("-"), repaired.cast("string"), F.lit("."), severity.cast("string"), F.lit("."), effect.cast("string"), F.lit(": "), F.concat_ws(".", grid, model, ident.cast("string")))


def fault_text(executor: Column, start: Column, stop: Column) -> Column:
    return F.concat(F.lit("Fault(executor="), executor, F.lit(", start_time="), start.cast("string"), F.lit(", stop_time="), stop.cast("string"), F.lit(")"))


def normal_density(x: Column, centre: Column | float) -> Column:
    d = x - centre
    return F.exp(-(d * d) / 2) / math.sqrt(2 * math.pi)


def incident_density(time: Column, timesteps: int, shift: int) -> Column:
    return normal_density(time, (timesteps + shift) / 2)


def impact_factor(grid: Column, power: float, heat: float, gas: float, mes: float) -> Column:
    """By grid label; heat and water are one carrier, no label or several are coupled ones."""
    return F.when(grid.isin("water", "heat"), heat).when(grid == "power", power).when(grid == "gas", gas).otherwise(mes)


def failure_probability(kind: Column, grid: Column, time: Column, noise: Column, *, timesteps: int = 10, shift: int = 5, power: float = 5, heat: float = 0.1, gas: float = 0.1, mes: float = 1, base_fail: float = 0.3) -> Column:
    """0 for types without a base probability."""
    base = F.when(kind.isNull(), 0.0).otherwise(lookup(fixed.BASE_FAILURE, kind, 0.0))
    return base * noise * impact_factor(grid, power, heat, gas, mes) * incident_density(time, timesteps, shift) * base_fail


def repair_duration(damage: Column, delay: float, normal: Column, least: int) -> Column:
    return F.greatest(normal + delay + damage / 10, F.lit(float(least)))


def relative_violation(value: Column, target: Column, relative: Column) -> Column:
    return F.greatest(F.try_divide(F.abs(value - target) - relative * target, target * relative), F.lit(0.0))


def violation_probability(violation: Column, ramp: float = 0.0, steepness: float = 1.0, exponent: float = 1.5) -> Column:
    return steepness * F.pow(F.greatest((violation - ramp) * 100, F.lit(0.0)), exponent) / 100


def minimum_duration(probability: Column, uniform: Column) -> Column:
    return (probability * uniform * 10).cast("int")


def impact_ratio(inside: Column, outside: Column) -> Column:
    """How much worse it is inside: positive if worse, negative the other way round, -1 if equal; null if either is."""
    e = fixed.SMALL
    return F.when(inside > outside, (inside + e) / (outside + e)).otherwise(-(outside + e) / (inside + e))


def mass_flow_to_mw(higher_heating_value: Column | float) -> Column:
    return F.lit(higher_heating_value) * 3600 / 1e3 if not isinstance(higher_heating_value, Column) else higher_heating_value * 3600 / 1e3


def bounds(target: Column, relative: Column) -> tuple[Column, Column]:
    return target * (1 - relative), target * (1 + relative)


def is_load(model: Column, grid: Column) -> Column:
    return (model == "PowerLoad") | ((model == "Sink") & (grid == "gas")) | (model == "HeatExchangerLoad")


def plot_class(model: Column, independent: Column) -> Column:
    """Class of a node in a network plot."""
    return F.when(~independent, "cp").when(model.contains("Water"), "heat").when(model.contains("Gas"), "gas").when(model.contains("Power") | (model == "Bus"), "power").otherwise("heat")


def edge_loss(carrier: Column, losses: Column) -> Column:
    return F.when(carrier == "heat", losses[1]).otherwise(losses[0])


def layer_shift(layer: Column) -> tuple[Column, Column]:
    """How far a chart moves the points of a layer, in x and y."""
    known = F.when(layer.isin(*fixed.LAYER_SHIFT), layer).otherwise("None")
    return tuple(lookup({k: v[i] for k, v in fixed.LAYER_SHIFT.items()}, known) for i in (0, 1))


def legacy_id(network: Column, kind: Column, component: Column) -> Column:
    return F.concat(network.cast("string"), F.lit(":"), kind, F.lit(":"), component.cast("string"))


def title_or(titles: Column, place: int, default: Column) -> Column:
    """The title at a place of a list that may be null or too short, else the default."""
    return F.coalesce(F.get(titles, place), default)
