"""Rollups of impacts and their join with network metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import fixed

#: keys of the rollups by name; each has a mean and a sum
ROLLUPS = {"type_carrier": ("type_carrier", "carrier"), "type": ("type", "carrier"), "type_carrier_density": ("type_carrier", "carrier", "cp_density"), "carrier_density": ("carrier", "cp_density")}


def rollup(impacts: DataFrame, name: str, how: str, value: str = "impact") -> DataFrame:
    """Mean or sum of absolute impacts by the keys of a rollup; rows with a null key or value are passed over."""
    keys = ROLLUPS[name]
    rows = impacts.where(" and ".join(f"{c} is not null" for c in (*keys, value)))
    return rows.groupBy(*keys).agg((F.avg if how == "mean" else F.sum)(F.abs(value)).alias(value))


def all_rollups(impacts: DataFrame, value: str = "impact") -> DataFrame:
    """All rollups in one pass: rollup, keys (null where not grouped by), mean and sum."""
    sets = [[F.col(c) for c in keys] for keys in ROLLUPS.values()]
    names = ["type_carrier", "type", "carrier", "cp_density"]
    rows = impacts.where(" and ".join(f"{c} is not null" for c in (*names, value)))
    flags = {n: F.grouping(n) for n in names}
    out = rows.groupingSets(sets, *names).agg(F.avg(F.abs(value)).alias("mean"), F.sum(F.abs(value)).alias("total"), *(f.alias("_" + n) for n, f in flags.items()))
    name = F.when((F.col("_type") == 0), "type").when(F.col("_type_carrier") == 1, "carrier_density").when(F.col("_cp_density") == 0, "type_carrier_density").otherwise("type_carrier")
    return out.select(name.alias("rollup"), *names, "mean", "total")


def with_metrics(impacts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Impacts with the metrics of their component and density; the metrics' type counts."""
    m = metrics.select(F.col("id").alias("node"), "cp_density", F.col("type").alias("type_y"), *fixed.METRICS)
    return impacts.where("impact is not null").join(m, ["node", "cp_density"]).drop("type")


def over_carriers(joined: DataFrame) -> DataFrame:
    """Summed impacts of all carriers of a component, next to its metrics."""
    return joined.where("type_y is not null and cp_density is not null").groupBy("type_y", "cp_density", "node", *fixed.METRICS).agg(F.sum("impact").alias("impact"))


def by_type_group(joined: DataFrame) -> DataFrame:
    """Each row once for every group that its type is in, by one join for all groups."""
    spark = joined.sparkSession
    groups = spark.createDataFrame([(g, t) for g, types in fixed.TYPE_GROUPS.items() for t in types], "type_group string, type_y string")
    return joined.join(groups, "type_y")


def metric_impact_frame(joined: DataFrame) -> DataFrame:
    """All scatter charts as one frame: carrier, metric, type group (all among them), metric value and impact."""
    named = joined.withColumn("type_group", F.lit("all")).unionByName(by_type_group(joined))
    ids = ["carrier", "cp_density", "node", "type_y", "type_group", "impact"]
    return named.select(*ids, *(F.col(m).cast("double") for m in fixed.METRICS)).unpivot(ids, list(fixed.METRICS), "metric", "value")


def densities(df: DataFrame) -> DataFrame:
    """The densities that occur, in order."""
    return df.select("cp_density").distinct().orderBy("cp_density")
