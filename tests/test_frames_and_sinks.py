"""Frames and their sinks, sweeps, recovered steps, and streams of losses and observations."""

import datetime
import json
import os

from pyspark.sql import functions as F

from gridspark.operators import frames, simulation
from gridspark.sources import experiments
from gridspark.streaming import faults


def test_bars_and_their_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None), (3, None, "b")], "a int, v double, k string")
    out = frames.bar(df, "a", "v", "k")
    assert sorted(map(tuple, out.collect()), key=repr) == [("1", 2.0, None), ("3", None, "b")]
    frames.write_json({"im<pact>/x": out, "y": df}, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["impactx", "y"]
    lines = [json.loads(x) for n in os.listdir(tmp_path / "impactx") if n.endswith(".json") for x in open(tmp_path / "impactx" / n)]
    assert sorted(lines, key=repr) == [{"x": "1", "y": 2.0}, {"x": "3", "color": "b"}]


def test_csv_is_read_as_it_was_written(spark, tmp_path):
    df = spark.createDataFrame([("branch:(0, 1, 0)", "gas", -1.5, "GasPipe", 0.5), ("node:1", "heat", None, "Bus", 1.0)], experiments.IMPACT)
    experiments.write_csv(df, f"{tmp_path}/impact.csv")
    back = spark.read.schema(experiments.IMPACT).option("header", True).csv(f"{tmp_path}/impact.csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_steps_are_recovered_within_runs(spark):
    df = spark.createDataFrame([("e", 1, 30, "c"), ("e", 1, 10, "a"), ("e", 2, 5, "x"), ("f", 1, 20, "b")], "experiment string, id long, at long, v string")
    got = {(r.experiment, r.id, r.v): r.step for r in experiments.recovered_step(df, "at").collect()}
    assert got == {("e", 1, "a"): 0, ("e", 1, "c"): 1, ("e", 2, "x"): 0, ("f", 1, "b"): 0}


def test_sweep(spark):
    rows = simulation.sweep(spark, [(1, 2, 3, 4), (5, 6, 7, 8)], [0.0, 0.5, 1.0], 4).collect()
    assert len(rows) == 24 and len({(r.impact_no, r.density_no, r.run_no) for r in rows}) == 24
    assert {(r.power, r.gas, r.heat, r.mes) for r in rows if r.impact_no == 1} == {(5.0, 6.0, 7.0, 8.0)}


def test_losses_by_window_of_time(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = [(day(1), "e", 1.0, 2.0, 3.0), (day(1, 5), "e", 1.0, 0.0, 0.0), (day(2), "e", 5.0, 0.0, 0.0), (day(1), "f", 7.0, 0.0, 0.0), (day(9), "e", 0.0, 0.0, 0.0)]
    schema = "t timestamp, experiment string, p0 double, p1 double, p2 double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = faults.windowed_loss(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "t")
    query = stream.writeStream.format("memory").queryName("losses").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.experiment, r.window.start.day): r.p0 for r in spark.table("losses").collect()}
    assert got[("e", 1)] == 2.0 and got[("e", 2)] == 5.0 and got[("f", 1)] == 7.0


def test_observations_are_appended_once(spark, tmp_path):
    spark.range(5).select("id", F.lit("e").alias("experiment")).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long, experiment string").parquet(f"{tmp_path}/in")
        faults.append_observations(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(5))
