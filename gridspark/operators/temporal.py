"""Series over the steps of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spine(keys: DataFrame, steps: int) -> DataFrame:
    """Every step for every row of keys."""
    return keys.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))


def carried_forward(series: DataFrame, run: list[str], values: list[str]) -> DataFrame:
    """The last value that is not null, for values that are only computed when something changes."""
    w = Window.partitionBy(*run).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def padded(series: DataFrame, keys: DataFrame, run: list[str], steps: int, default: float) -> DataFrame:
    """All steps of all runs, with a default where the series has none."""
    out = spine(keys.select(*run).distinct(), steps).join(series, [*run, "step"], "left")
    return out.fillna(default, [c for c in series.columns if c not in (*run, "step")])


def fault_states(events: DataFrame, run: list[str], steps: int) -> DataFrame:
    """Whether a component is active after each step: its last event decides, of one step the latest in order.

    events: run, node, step, position (in the fault list), kind (0 failure, 1 repair).  Failures of a
    component do not count references, so one repair ends all of them.
    """
    last = events.where(F.col("step") < steps).groupBy(*run, "node", "step").agg(F.max_by("kind", F.struct("position", "kind")).alias("kind"))
    full = spine(events.select(*run, "node").distinct(), steps).join(last, [*run, "node", "step"], "left")
    w = Window.partitionBy(*run, "node").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("active", F.coalesce(F.last("kind", ignorenulls=True).over(w), F.lit(1)) == 1).drop("kind")


def state_intervals(events: DataFrame, run: list[str], steps: int) -> DataFrame:
    """run, node, begin, until, active: the stretches of steps (until is the first one after) in which a component's state is the same.

    What fault_states() says of every step, in a row for each change; a component is active before its first event.
    """
    last = events.where((F.col("step") >= 0) & (F.col("step") < steps)).groupBy(*run, "node", "step").agg(F.max_by("kind", F.struct("position", "kind")).alias("kind"))
    first = events.select(*run, "node").distinct().select(*run, "node", F.lit(-1).cast(events.schema["step"].dataType).alias("step"), F.lit(1).cast(events.schema["kind"].dataType).alias("kind"))
    place = Window.partitionBy(*run, "node").orderBy("step")
    changed = last.unionByName(first).withColumn("_before", F.lag("kind").over(place)).where("_before is null or _before <> kind")
    out = changed.select(*run, "node", F.greatest("step", F.lit(0)).alias("begin"), F.lead("step", 1, steps).over(place).alias("until"), (F.col("kind") == 1).alias("active"))
    return out.where("begin < until")


def states_at(intervals: DataFrame, asked: DataFrame, run: list[str]) -> DataFrame:
    """run, node, step, active of all components at the steps that are asked for (run, step)."""
    a = asked.select(*(F.col(c).alias("_" + c) for c in run), "step").distinct()
    same = [intervals[c] == F.col("_" + c) for c in run]
    return intervals.join(a, [*same, F.col("step") >= F.col("begin"), F.col("step") < F.col("until")]).select(*(intervals[c] for c in run), "node", "step", "active")


def change_steps(events: DataFrame, run: list[str]) -> DataFrame:
    """Run and step of the steps at which something has to be solved: the first and those with a fault's start or stop."""
    return events.select(*run, "step").union(events.select(*run, F.lit(0).cast(events.schema["step"].dataType).alias("step"))).distinct()
