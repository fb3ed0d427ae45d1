"""Frames that charts are drawn from, and their sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.numbering import numbered


def grouped_histogram(df: DataFrame, x: str, y: str, color: str) -> DataFrame:
    return df.groupBy(x, color).agg(F.sum(y).alias(y))


def bar(df: DataFrame, x: str, y: str, color: str) -> DataFrame:
    return df.select(F.col(x).cast("string").alias("x"), F.col(y).alias("y"), F.col(color).cast("string").alias("color"))


def series(df: DataFrame, x: str, values: list[str]) -> DataFrame:
    """One line for each column."""
    return df.select(x, *(F.col(v).cast("double").alias(v) for v in values)).unpivot([x], values, "line", "value")


def grouped_positions(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Bars at i + 0.5 * (i div size): a gap after every ``size`` bars."""
    spots = numbered(df.select(*order).distinct(), order, "_i")
    return df.join(spots, order).withColumn("x", F.col("_i") + 0.5 * F.floor(F.col("_i") / size)).drop("_i")


def stacked(df: DataFrame, order: list[str], part: str, value: str, size: int) -> DataFrame:
    """Bars with gaps, their parts, the height of each stack and the axis end (the highest stack and a half)."""
    placed = grouped_positions(df, order, size)
    height = placed.groupBy("x").agg(F.sum(value).alias("height"))
    top = height.agg((F.max("height") + 0.5).alias("y_end"))
    return placed.join(height, "x").crossJoin(top).select("x", *order, part, F.col(value).alias("value"), "height", "y_end")


def multi_bar(df: DataFrame, x: str, names: list[str]) -> DataFrame:
    """x, name, y: a set of bars for each column, all at the same places; a missing value is no bar."""
    return df.select(x, *(F.col(n).cast("double").alias(n) for n in names)).unpivot([x], names, "name", "y").where("y is not null")


def color_range(points: list[DataFrame], by: list[str], color: str = "color") -> DataFrame:
    """Least and greatest color of each chart, over all its points and edges."""
    rows = reduce(DataFrame.unionByName, [p.select(*by, F.col(color).cast("double").alias("_c")) for p in points])
    return rows.groupBy(*by).agg(F.min("_c").alias("least"), F.max("_c").alias("greatest"))


def wide(df: DataFrame, index: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """A column for each of the names, with the sum of its values; names that a row lacks are null."""
    return df.groupBy(*index).pivot(column, names).agg(F.sum(value))


def write_json(frames: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each frame; names lose / < >."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name.translate(str.maketrans('', '', '/<>'))}")
