"""Experiment folders: CSV files of runs, their descriptors, and cached results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERFORMANCE = T.StructType([T.StructField("step", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "012"), T.StructField("id", T.LongType())])
EVENTS = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("step", T.LongType()), T.StructField("node", T.StringType()), T.StructField("type", T.StringType()), T.StructField("id", T.LongType())])
METRICS = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("betweenness_centrality", "degree", "vc", "katz", "cp_density"))])
IMPACT = T.StructType([T.StructField("id", T.StringType()), T.StructField("carrier", T.StringType()), T.StructField("impact", T.DoubleType()), T.StructField("type", T.StringType()), T.StructField("cp_density", T.DoubleType())])


def annotate(df: DataFrame, experiment: Column) -> DataFrame:
    """Adds the path and what its last part says: impacts as text, density as a number."""
    parts = F.split(F.element_at(F.split(experiment, "/"), -1), "-")
    names = ("power_impact", "heat_impact", "gas_impact", "mes_impact")
    return df.withColumn("experiment", experiment).withColumns({n: parts[i + 1] for i, n in enumerate(names)} | {"cp_density": parts[5].cast("double")})


def _folder() -> Column:
    return F.regexp_extract(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), "^(.*)/[^/]+$", 1)


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0


def read_csv(spark: SparkSession, root: str, name: str, schema: T.StructType, required: bool = True) -> DataFrame:
    """name.csv of all folders under root in one scan, annotated; NaN becomes null.

    An optional file that no folder has gives an empty frame.  Paths are those under root, so that the
    scenario is found however long the root's own path is.
    """
    pattern = f"{root.rstrip('/')}/*/{name}.csv"
    if not required and not _exists(spark, pattern):
        return annotate(spark.createDataFrame([], schema), F.lit("a/b/x-0-0-0-0-0"))
    df = spark.read.schema(schema).option("header", True).csv(pattern)
    nan = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in schema if f.dataType == T.DoubleType()}
    df = df.withColumn("_folder", _folder()).withColumns(nan)
    place = F.concat(F.lit("data/results/"), F.element_at(F.split("_folder", "/"), -1))
    return annotate(df, place).drop("_folder")


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Performance, failures and repairs of all experiments under root; performance rows that lack a value are left out."""
    performance = read_csv(spark, root, "performance", PERFORMANCE).na.drop("any", subset=PERFORMANCE.names)
    return performance, read_csv(spark, root, "failure", EVENTS, False), read_csv(spark, root, "repair", EVENTS, False)


def recovered_step(perf: DataFrame, order: str) -> DataFrame:
    """Steps as row numbers within a run, for tables whose steps were not stored."""
    from pyspark.sql import Window

    return perf.withColumn("step", F.row_number().over(Window.partitionBy("experiment", "id").orderBy(order)) - 1)


def first_network_by_density(networks: DataFrame) -> DataFrame:
    """Of several networks (network_id, path, cp_density) of a density the first by path."""
    return networks.groupBy("cp_density").agg(F.min_by("network_id", "path").alias("network_id"))


def append(df: DataFrame, path: str, partition: str = "experiment") -> None:
    """Adds observations to a table; what a task wrote appears when the job commits, so writers need no lock."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def clear(spark: SparkSession, path: str) -> bool:
    """Removes all observations of a table; False if there were none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cached(spark: SparkSession, path: str, inputs: Sequence[DataFrame], compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was made of the same input files (names, lengths and times of change), else computed and written there."""
    import hashlib

    def state(name: str) -> str:
        file = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file)
        return f"{name} {status.getLen()} {status.getModificationTime()}"

    mark = hashlib.sha256("\n".join(sorted(state(f) for df in inputs for f in df.inputFiles())).encode()).hexdigest()[:16]
    place = f"{path.rstrip('/')}/{mark}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
