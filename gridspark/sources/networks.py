"""Networks as tables of parquet, and which network belongs to a density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.sources.experiments import _exists, first_network_by_density

TABLES = ("nodes", "branches", "children", "compounds")


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Stores tables that have a network_id (long) and a cp_density; networks that are there already are replaced, others stay."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"{name} is none of {', '.join(TABLES)}")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("network_id").parquet(f"{path.rstrip('/')}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that are there; a filter on network_id reads the folders of those networks only."""
    root = path.rstrip("/")
    return {n: spark.read.parquet(f"{root}/{n}").withColumn("network_id", F.col("network_id").cast("long")) for n in TABLES if _exists(spark, f"{root}/{n}")}


def of_density(rows: DataFrame, networks: DataFrame) -> DataFrame:
    """rows with the network_id of their density: of several the first by path, null where there is none."""
    return rows.join(first_network_by_density(networks), "cp_density", "left")
