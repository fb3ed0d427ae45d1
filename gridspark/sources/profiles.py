"""Demand profiles: hourly series, scaled and attached to components."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import rng
from gridspark.operators.numbering import numbered


def first_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def upsample(df: DataFrame, hour: str = "hour", times: int = 4) -> DataFrame:
    """Each hourly value held for ``times`` steps."""
    return df.withColumn("step", F.explode(F.sequence(F.col(hour) * times, F.col(hour) * times + (times - 1))))


def demand(columns: list[Column], minus: Column | None = None) -> Column:
    total = sum(columns[1:], columns[0])
    return total if minus is None else total - minus


def heat_demand(kw: Column) -> Column:
    """kW to W."""
    return kw * 1000


def gas_demand(kw: Column, factor: float) -> Column:
    """kW to mass flow by the carrier's heating value."""
    return kw / (factor * 1000)


def attach_by_position(series: DataFrame, components: DataFrame, column_order: str, component_order: str) -> DataFrame:
    """The i-th profile to the i-th component, in the given orders."""
    names = series.select("profile", F.col(column_order).alias("_o")).distinct()
    left = numbered(names, ["_o", "profile"], "_i").select("profile", "_i")
    right = numbered(components, [component_order], "_i")
    return series.join(left, "profile").join(right, "_i").drop("_i")


def scaled(series: DataFrame, nominal: str) -> DataFrame:
    return series.withColumn("value", F.col("value") * F.col(nominal))


def random_profile(components: DataFrame, steps: int, seed: int, centre: float = 0.0, deviation: float = 0.1, absolute: bool = False) -> DataFrame:
    """component_id, step, value: normal noise for every component and step."""
    grid = components.select("component_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    value = rng.normal(centre, deviation, seed, F.col("component_id"), F.col("step"))
    return grid.withColumn("value", F.abs(value) if absolute else value)


def random_demand(loads: DataFrame, heat: DataFrame, sinks: DataFrame, steps: int, seed: int) -> DataFrame:
    """carrier, component_id, step, value: noise for the components of all carriers, with a sign for heat only."""
    parts = (("electricity", loads, True), ("heat", heat, False), ("gas", sinks, True))
    return reduce(DataFrame.unionByName, [random_profile(c, steps, seed, absolute=a).select(F.lit(n).alias("carrier"), "component_id", "step", "value") for n, c, a in parts])


def merged(series: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Sets of series as one: values of a key add up, keys of one set only stay as they are."""
    rows = reduce(DataFrame.unionByName, [s.select(*keys, value) for s in series])
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))


def residential_demand(spark: SparkSession, pattern: str, plus: list[str], components: DataFrame, steps: int, minus: str | None = None, seed: int = 0) -> DataFrame:
    """component_id, step, value: the i-th file's demand (columns plus, less minus) for the i-th component, each hour held for four steps.

    Without any file there is a warning, and the components get signed noise.  Components beyond the files have no rows.
    """
    columns = list(dict.fromkeys([*plus, *([minus] if minus else [])]))
    try:
        hourly = read_csv(spark, pattern, columns, components.count(), steps)
    except FileNotFoundError:
        logging.getLogger(__name__).warning("no profiles at %s; random ones are used", pattern)
        return random_profile(components, steps, seed)
    value = demand([F.col(f"`{c}`") for c in plus], F.col(f"`{minus}`") if minus else None)
    series = hourly.select("profile", "hour", value.alias("value"))
    placed = attach_by_position(series, components.select("component_id"), "profile", "component_id")
    return upsample(placed).select("component_id", "step", "value")


def absolute_profiles(spark: SparkSession, path: str) -> DataFrame:
    """component_id, step, value as stored; a table without rows is an error."""
    out = spark.read.parquet(path).select("component_id", "step", "value")
    if out.isEmpty():
        raise ValueError(f"no profiles in {path}")
    return out


def read_csv(spark: SparkSession, pattern: str, columns: list[str], files: int, steps: int) -> DataFrame:
    """profile, hour and the named columns of the first files by name and of their first steps / 4 hours.

    One scan, however many files there are; columns go by the names in each file's own header.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    chosen = sorted(f.getPath().toString() for f in found)[:files]
    if not chosen:
        raise FileNotFoundError(pattern)
    hours = steps // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pyarrow.csv.ConvertOptions(include_columns=columns, column_types=dict.fromkeys(columns, pa.float64()))
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = pyarrow.csv.read_csv(pa.BufferReader(content.as_buffer()), read_options=pyarrow.csv.ReadOptions(use_threads=False), convert_options=options).slice(0, hours)
                n = table.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64()), *(table.column(c).combine_chunks() for c in columns)], names=["profile", "hour", *columns])

    named = ", ".join(f"`{c}` double" for c in columns)
    return spark.read.format("binaryFile").load(chosen).select("path", "content").mapInArrow(run, f"profile string, hour long, {named}")
