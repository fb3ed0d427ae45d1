"""Fault intervals, their joins with performance, and what a component's failure changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import fixed
from gridspark.functions.scalar import component_key, impact_ratio

RUN = ("cp_density", "experiment", "id")


def fault_pairs(failures: DataFrame, repairs: DataFrame) -> DataFrame:
    """cp_density, experiment, id, node, failed, repaired for components with exactly one failure and one repair in a run."""
    both = failures.select(*RUN, "node", "step", F.lit(1).alias("failure")).unionByName(repairs.select(*RUN, "node", "step", F.lit(0).alias("failure")))
    grouped = both.where("node is not null and id is not null").withColumn("node", component_key(F.col("node"))).groupBy(*RUN, "node")
    counted = grouped.agg(F.count("*").alias("n"), F.sum("failure").alias("f"), F.min(F.when(F.col("failure") == 1, F.col("step"))).alias("failed"), F.min(F.when(F.col("failure") == 0, F.col("step"))).alias("repaired"))
    return counted.where("n = 2 and f = 1").select(*RUN, "node", "failed", "repaired")


def inside(perf: DataFrame, pairs: DataFrame) -> DataFrame:
    """Performance rows within the closed fault interval of each component of their run."""
    p = pairs.select(*(F.col(c).alias("_" + c) for c in RUN), "node", "failed", "repaired")
    on = [perf[c] == F.col("_" + c) for c in RUN] + [perf.step.between(F.col("failed"), F.col("repaired"))]
    return perf.join(p, on).select(perf["*"], "node")


def outside(perf: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each component (cp_density, node) the performance rows of its density that inside() does not have.

    The plain form, whose size is components times rows; impact() does without.
    """
    every = perf.join(nodes.select("cp_density", "node"), "cp_density")
    p = pairs.select(*(F.col(c).alias("_" + c) for c in RUN), F.col("node").alias("_node"), "failed", "repaired")
    within = [every[c] == F.col("_" + c) for c in RUN] + [every.node == F.col("_node"), every.step.between(F.col("failed"), F.col("repaired"))]
    return every.join(p, within, "left_anti")


def interval_sums(perf: DataFrame, pairs: DataFrame, columns: list[str], block: int = 1024) -> DataFrame:
    """cp_density, node and, for each column, sum (in_s_) and number (in_n_) of its values within the node's fault intervals.

    By running sums: what a run has lost up to the repair less what it had lost before the failure, so a pair costs
    two look-ups, however long its interval is.  Both are questions put between the steps of their run, in blocks of
    ``block`` steps, so a long run is many short windows; the sums of whole blocks before are added.  Whole-number
    columns keep the difference exact.
    """
    names = [f"{k}_{c}" for c in columns for k in "sn"]
    steps = perf.groupBy(*RUN, "step").agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("s", F.sum), ("n", F.count))))
    asked = pairs.where("failed <= repaired").na.drop("any", subset=list(RUN))
    ends = F.array(F.struct(F.col("failed").alias("step"), F.lit(0).alias("kind"), F.lit(-1).alias("sign")), F.struct(F.col("repaired").alias("step"), F.lit(2).alias("kind"), F.lit(1).alias("sign")))
    questions = asked.select(*RUN, "node", F.explode(ends).alias("e")).select(*RUN, "node", "e.*")
    both = steps.withColumn("kind", F.lit(1)).unionByName(questions, allowMissingColumns=True).withColumn("block", F.floor(F.col("step") / block))
    place = Window.partitionBy(*RUN, "block").orderBy("step", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*RUN).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy(*RUN, "block").agg(*(F.sum(c).alias(c) for c in names)).select(*RUN, "block", *(F.sum(c).over(earlier).alias("b_" + c) for c in names))
    answers = both.withColumns({c: F.sum(c).over(place) for c in names}).where("sign is not null").join(before, [*RUN, "block"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return answers.groupBy("cp_density", "node").agg(*(F.sum(F.col("sign") * (zero(c) + zero("b_" + c))).alias("in_" + c) for c in names))


def _ratios(total: DataFrame, within: DataFrame, nodes: DataFrame, values: dict[str, str], scale: float) -> DataFrame:
    """Impacts of the nodes from sums and numbers of a density (s_, n_) and those within intervals (in_s_, in_n_)."""
    joined = nodes.join(total, "cp_density", "left").join(within, ["cp_density", "node"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = []
    for carrier, v in values.items():
        mean_in = F.try_divide(zero(f"in_s_{v}"), zero(f"in_n_{v}") * F.lit(scale))
        mean_out = F.try_divide(zero(f"s_{v}") - zero(f"in_s_{v}"), (zero(f"n_{v}") - zero(f"in_n_{v}")) * F.lit(scale))
        rows.append(F.struct(F.lit(carrier).alias("carrier"), impact_ratio(mean_in, mean_out).alias("impact")))
    return joined.select("cp_density", "node", "type", F.explode(F.array(*rows)).alias("r")).select("cp_density", "node", "type", "r.carrier", "r.impact")


def _totals(perf: DataFrame, columns: list[str]) -> DataFrame:
    return perf.groupBy("cp_density").agg(*(F.sum(c).alias(f"s_{c}") for c in columns), *(F.count(c).alias(f"n_{c}") for c in columns))


def impact(perf: DataFrame, pairs: DataFrame, nodes: DataFrame, values: dict[str, str], scale: float = 1.0) -> DataFrame:
    """cp_density, node, type, carrier, impact: the ratio of the means inside and outside of fault intervals.

    values: performance column by carrier.  Sums outside are those of the density less those inside, so
    performance is read once and joined with intervals only.  Whole-number columns (in units of 1 / scale)
    keep the difference exact.
    """
    columns = list(values.values())
    within = inside(perf, pairs).groupBy("cp_density", "node").agg(*(s.alias("in_" + c) for c, s in [(f"s_{v}", F.sum(v)) for v in columns] + [(f"n_{v}", F.count(v)) for v in columns]))
    return _ratios(_totals(perf, columns), within, nodes, values, scale)


def impact_by_running_sums(perf: DataFrame, pairs: DataFrame, nodes: DataFrame, values: dict[str, str], scale: float = 1.0) -> DataFrame:
    """What impact() gives, from interval_sums(): rows and pairs are each touched once, and no row is made for a step of an interval."""
    columns = list(values.values())
    return _ratios(_totals(perf, columns), interval_sums(perf, pairs, columns), nodes, values, scale)


def children_impact(impacts: DataFrame, members: DataFrame) -> DataFrame:
    """Mean impact of the children of each node (cp_density, node, child, type), by carrier."""
    joined = members.join(impacts.select("cp_density", F.col("node").alias("child"), "carrier", "impact"), ["cp_density", "child"])
    return joined.groupBy("cp_density", "node", "type", "carrier").agg(F.avg("impact").alias("impact"))


def extended_impact(impacts: DataFrame, members: DataFrame) -> DataFrame:
    """Impacts and, under their nodes' ids, the means of children; ids can occur twice, so origin tells them apart."""
    own = impacts.withColumn("origin", F.lit("own"))
    return own.unionByName(children_impact(impacts, members).withColumn("origin", F.lit("children")))


def scenario_resilience(perf: DataFrame, values: dict[str, str], scale: float = 1.0) -> DataFrame:
    """Sum over the steps of a run, mean over the runs of an experiment; one row for each carrier.

    id is the mean run id.  Labels are those of known scenarios, others keep their key.
    """
    from gridspark.functions.scalar import scenario_key, scenario_label

    runs = perf.where("cp_density is not null and experiment is not null and id is not null").groupBy(*RUN).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values.values()))
    means = runs.groupBy("cp_density", "experiment").agg(F.avg("id").alias("id"), *((F.sum(c) / (F.count(c) * F.lit(scale))).alias(k) for k, c in values.items()))
    long = means.unpivot(["cp_density", "experiment", "id"], list(values), "carrier", "resilience_mean")
    key = scenario_key(F.col("experiment"))
    return long.select("cp_density", key.alias("experiment"), scenario_label(key).alias("scenario"), "id", "carrier", "resilience_mean")


def run_total(perf: DataFrame, columns: list[str]) -> DataFrame:
    """The whole loss of each run."""
    return perf.groupBy(*RUN).agg(F.sum(sum((F.col(c) for c in columns[1:]), F.col(columns[0]))).alias("total"))


def typed(impacts: DataFrame) -> DataFrame:
    """Adds the carrier group of the type; unknown types are ``unknown``."""
    from gridspark.functions.scalar import lookup

    return impacts.withColumn("type_carrier", lookup(fixed.CARRIER, F.col("type"), "unknown"))
