"""Which components of a network are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.scalar import is_load


def relevant(children: DataFrame, branches: DataFrame) -> DataFrame:
    """Loads among children and branches (network_id, id, type, grid), with the kind that each is of."""
    both = children.select("network_id", "id", "type", "grid", F.lit("child").alias("kind")).union(branches.select("network_id", "id", "type", "grid", F.lit("branch")))
    return both.where(F.coalesce(is_load(F.col("type"), F.col("grid")), F.lit(False)))


def kth(children: DataFrame, kind: str, k: int, value: str) -> DataFrame:
    """network_id and the value of the network's k-th child (from 0, by id) of a type; networks with fewer have no row."""
    place = F.row_number().over(Window.partitionBy("network_id").orderBy("id")) - 1
    return children.where(F.col("type") == kind).withColumn("_k", place).where(F.col("_k") == k).select("network_id", value)


def grid_balance(children: DataFrame, value: str) -> DataFrame:
    """network_id, power, gas: what the first external power grid and the second external hydraulic grid of each network take, null without one."""
    power, gas = kth(children, "ExtPowerGrid", 0, value).withColumnRenamed(value, "power"), kth(children, "ExtHydrGrid", 1, value).withColumnRenamed(value, "gas")
    every = children.select("network_id").distinct()
    return every.join(power, "network_id", "left").join(gas, "network_id", "left")
