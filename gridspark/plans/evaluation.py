"""From folders of results to impacts, their rollups and the resilience of scenarios, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import impact, rollup
from gridspark.sources import folders

CARRIERS = {"electricity": "c0", "heat": "c1", "gas": "c2"}


def evaluate(spark: SparkSession, path: str, components: DataFrame, where: str | None = None, scale: float = 1.0) -> dict[str, DataFrame]:
    """impact, rollups, scenarios, densities of the experiments under path.

    components: cp_density, node, type; where: a condition on what folders' names say, which chooses the folders that
    are read; scale: performance is in units of 1 / scale, and sums of whole units do not depend on the order of rows.
    Impacts in rollups are in whole thousandths.
    """
    tables = {t: folders.load(spark, path, t) for t in folders.TABLES}
    if where:
        tables = {t: df.where(where) for t, df in tables.items()}
    perf = tables["performance"]
    pairs = impact.fault_pairs(tables["failure"], tables["repair"])
    found = impact.impact_by_running_sums(perf, pairs, components, CARRIERS, scale)
    milli = impact.typed(found).withColumn("impact", F.round(F.col("impact") * 1000).cast("long"))
    return {"impact": found, "rollups": rollup.all_rollups(milli), "scenarios": impact.scenario_resilience(perf, CARRIERS, scale), "densities": rollup.densities(perf)}
