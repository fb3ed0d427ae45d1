"""Experiment folders as a data source, and the sink for observations."""

import math
import os

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from gridspark.plans import evaluation
from gridspark.sources import folders


@pytest.fixture
def root(tmp_path):
    def put(folder, name, text):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / f"{name}.csv").write_text(text)

    for density in ("0.0", "0.5", "2.0"):
        put(f"net-5-0-0-0-{density}", "performance", ",0,1,2,id\n" + "".join(f"{k},{k}.5,,{'nan' if k == 3 else k},{k % 2}\n" for k in range(20)))
        put(f"net-0-3-0-0-{density}", "performance", ",0,1,2,id\n" + "".join(f"{k},1.0,2.0,3.0,7\n" for k in range(50)))
        put(f"net-0-3-0-0-{density}", "failure", ',step,node,type,id\n0,3,"l:PowerLine:(0, 1, 0)",failure,7\n1,4,a:b:5,failure,7\n')
    put("net-0-3-0-0-0.5", "repair", ',step,node,type,id\n0,9,"l:PowerLine:(0, 1, 0)",repair,7')
    put("other", "performance", "no,such\n1,2\n")
    (tmp_path / "net-file-0-0-0-1.0").write_text("not a folder")
    return str(tmp_path)


def read(spark, root, table):
    folders.register(spark)
    return spark.read.format("experiments").option("table", table).load(root)


@pytest.mark.parametrize("size", [folders.RANGE, 64, 7])
def test_rows(spark, root, monkeypatch, size):
    """However many ranges a file is cut into, and whatever a line has at its ends."""
    monkeypatch.setattr(folders, "RANGE", size)
    reader = folders.ExperimentReader(root, "performance", read(spark, root, "performance").schema)
    got = sorted((tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()), key=repr)
    want = [(k, k + 0.5, None, None if k == 3 else float(k), k % 2, f"data/results/net-5-0-0-0-{d}", "5", "0", "0", "0", float(d)) for d in ("0.0", "0.5", "2.0") for k in range(20)]
    want += [(k, 1.0, 2.0, 3.0, 7, f"data/results/net-0-3-0-0-{d}", "0", "3", "0", "0", float(d)) for d in ("0.0", "0.5", "2.0") for k in range(50)]
    assert got == sorted(want, key=repr)


def test_tables(spark, root):
    assert read(spark, root, "performance").count() == 210 and folders.load(spark, root, "performance").count() == 150
    nodes = {r.node for r in read(spark, root, "failure").collect()}
    assert nodes == {"l:PowerLine:(0, 1, 0)", "a:b:5"} and read(spark, root, "repair").count() == 1
    with pytest.raises(Exception, match="none of"):
        read(spark, root, "network").collect()


def test_filters_choose_folders(spark, root):
    df = read(spark, root, "performance")
    reader = folders.ExperimentReader(root, "performance", df.schema)
    step = ds.GreaterThan(("step",), 3)
    assert list(reader.pushFilters([ds.EqualTo(("power_impact",), "0"), step, ds.Not(ds.LessThan(("cp_density",), 0.5)), ds.In(("cp_density",), (0.5, 9.0))])) == [step]
    assert [p.file.split("/")[-2] for p in reader.partitions()] == ["net-0-3-0-0-0.5"]
    assert df.where("cp_density >= 0.5 and power_impact = '0' and step < 2").count() == 4
    assert df.where("cp_density = 77").isEmpty() and df.where("experiment like '%2.0' and step = 1").count() == 2
    # a folder that is not chosen is not looked into
    os.makedirs(f"{root}/net-9-0-0-0-1.0")
    assert df.where("power_impact <> '9'").count() == 210
    with pytest.raises(Exception, match="has no performance.csv"):
        read(spark, root, "performance").count()


@pytest.mark.parametrize("f, want", [
    (ds.EqualTo(("cp_density",), 1.0), True), (ds.EqualTo(("cp_density",), math.nan), False), (ds.LessThan(("cp_density",), math.nan), True), (ds.IsNull(("experiment",)), False), (ds.IsNotNull(("experiment",)), True), (ds.StringContains(("gas_impact",), "3"), True),
    (ds.Not(ds.StringEndsWith(("experiment",), "1.0")), False), (ds.EqualTo(("id",), 3), None), (ds.Not(ds.EqualTo(("id",), 3)), None), (ds.In(("power_impact",), (None, "1")), True), (ds.GreaterThanOrEqual(("cp_density",), 1.5), False), (ds.LessThanOrEqual(("cp_density",), 1.0), True),
])
def test_tests(f, want):
    assert folders.holds(f, folders.described("net-1-2-3-4-1.0")) is want


@pytest.mark.parametrize("name", ["net", "a-b-c-d-e", "a-b-c-d-e-f"])
def test_names_that_say_nothing(name):
    assert folders.described(name) is None


SEEN = [("data/res/net-1-1-1-1-0.0", 1, "performance", k, f"[{k}, {k * 2}, 0]") for k in range(9)]
SEEN += [("net-1-1-1-1-0.0", 1, "failure", 0, '{"step": 2, "node": "l:PowerLine:(0, 1, 0)", "type": "failure"}'), ("net-1-1-1-1-0.0", 1, "failure", 1, '{"step": 3, "type": "failure", "more": 1}'), ("net-1-1-1-1-0.0", 1, "count", 0, "7"), ("net-1-1-1-1-0.0", 1, "count", 1, None)]


def test_observations(spark, tmp_path):
    folders.register(spark)
    frame = spark.createDataFrame(SEEN, folders.OBSERVATIONS)
    for _ in range(2):
        folders.append(frame.repartition(3), str(tmp_path))
    got = read(spark, str(tmp_path), "performance")
    assert sorted((r.step, r.c0, r.c1, r.id) for r in got.collect()) == sorted((k, float(k), 2.0 * k, 1) for k in range(9) for _ in range(2))
    assert sorted((r.ordinal, r.step, r.node, r.id) for r in read(spark, str(tmp_path), "failure").collect()) == sorted([(0, 2, "l:PowerLine:(0, 1, 0)", 1)] * 2) + sorted([(1, 3, None, 1)] * 2)
    assert sorted(os.listdir(tmp_path / "net-1-1-1-1-0.0")) == ["failure.csv", "performance.csv"]  # single values make no rows
    assert os.listdir(tmp_path / "_staging") == []
    with pytest.raises(Exception, match="appended"):
        frame.write.format("experiments").mode("overwrite").save(str(tmp_path))


def rows(n=9):
    return [dict(zip(("experiment", "id", "key", "position", "value"), s, strict=True)) for s in SEEN[:n]]


def found(tmp_path):
    return sorted(line.split(",")[0] for d, _, names in os.walk(tmp_path) if "_staging" not in d for n in names if n.endswith(".csv") for line in open(f"{d}/{n}").read().splitlines()[1:])


def test_tasks_that_fail_or_run_twice(tmp_path, monkeypatch):
    """Files of a task that was killed on its way, and of a second attempt, are not published."""
    monkeypatch.setattr(folders, "FLUSH", 2)
    writer = folders.ObservationWriter(str(tmp_path))

    def killed():
        yield from rows(5)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    twice = [writer.write(iter(rows())) for _ in range(2)]
    assert found(tmp_path) == []
    writer.commit([twice[1], None])
    assert found(tmp_path) == [str(k) for k in range(9)]
    lost = folders.ObservationWriter(str(tmp_path))
    lost.abort([lost.write(iter(rows()))])
    assert found(tmp_path) == [str(k) for k in range(9)] and os.listdir(tmp_path / "_staging") == []


def test_batches_that_come_again(tmp_path):
    for batch, attempts in ((0, 2), (1, 1)):
        for _ in range(attempts):
            writer = folders.ObservationStreamWriter(str(tmp_path), "s")
            writer.commit([writer.write(iter(rows(3)))], batch)
    assert found(tmp_path) == ["0", "0", "1", "1", "2", "2"]


def test_stream(spark, tmp_path):
    folders.register(spark)
    spark.createDataFrame(SEEN, folders.OBSERVATIONS).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second time there is nothing new
        stream = spark.readStream.schema(folders.OBSERVATIONS).parquet(f"{tmp_path}/in")
        query = stream.writeStream.format("experiments").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert read(spark, f"{tmp_path}/out", "performance").count() == 9


def test_evaluation_of_some_folders(spark, root):
    folders.register(spark)
    nodes = spark.createDataFrame([(d, n, "PowerLine") for d in (0.0, 0.5, 2.0) for n in ("branch:(0, 1, 0)", "node:5")], "cp_density double, node string, type string")
    out = evaluation.evaluate(spark, root, nodes, where="power_impact = '0'")
    assert {(r.cp_density, r.node): r.impact for r in out["impact"].where("carrier = 'heat'").collect()}[0.5, "branch:(0, 1, 0)"] == -1.0
    assert out["impact"].where("impact is not null").select("cp_density").distinct().count() == 1
    assert {(r.experiment, r.carrier): r.resilience_mean for r in out["scenarios"].where("cp_density = 0").collect()} == {("0-3-0-0", "electricity"): 50.0, ("0-3-0-0", "heat"): 100.0, ("0-3-0-0", "gas"): 150.0}
    assert out["densities"].count() == 3 and out["rollups"].where(F.col("mean") < 0).isEmpty()
