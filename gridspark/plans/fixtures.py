"""Domain tables made from the driver's tables; SQL has the same derivations as named parts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions.scalar import lookup
from gridspark.operators import powerflow
from gridspark.operators.graph import nodes, weighted
from gridspark.sources import folders
from gridspark.sources.shared import folder, stored

CENTS = {"electricity": "c0", "heat": "c1", "gas": "c2"}
#: scenario keys of the three made-up experiments; the last has no label
LABELS = ("0-0-0-3", "0-3-0-0", "5-5-5-5")
#: part type -> component type
PART_TYPES = {"ECONOMY": "PowerGenerator", "STANDARD": "GenericPowerBranch", "PROMO": "HeatExchanger", "SMALL": "Source", "MEDIUM": "GasPipe", "LARGE": "Trafo"}
#: types of the twenty made-up components
TYPES = ("Bus", "Junction", "PowerGenerator", "Source", "PowerLoad", "Sink", "HeatExchanger", "Bus", "GenericPowerBranch", "WaterPipe", "GasPipe", "PowerLine", "PowerLoad", "Sink", "HeatExchangerLoad", "Source", "CHP", "CHP", "PowerToHeat", "PowerToHeat")


#: rows that are counted in one task, about
ROWS = 2_000_000
#: pairs that a task holds before it counts them, about
PAIRS = 4_000_000


def _tasks(rows: float) -> int:
    """Tasks for so many rows, so that what one of them holds does not grow with the tables."""
    return max(1, math.ceil(rows / ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _experiment() -> Column:
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("user_id") % 3 + 1).cast("int"))
    return F.concat(F.lit("data/res/net-"), label, F.lit("-"), _density().cast("string"))


def _density() -> Column:
    return ((F.col("user_id") % 5) * 0.5).cast("double")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (F.dayofmonth("ts") - 1).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("user_id").alias("id"), step.alias("step"), _density().alias("cp_density"), _experiment().alias("experiment"))


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cp_density, experiment, id, step and the losses c0, c1, c2 in whole cents."""
    cents = F.round(F.col("value") * 100).cast("long")
    kinds = ("click", "view", "signup")
    rows = _run(spark, sf_dir).where(F.col("event_type").isin(*kinds))
    return rows.groupBy("cp_density", "experiment", "id", "step").agg(*(F.coalesce(F.sum(F.when(F.col("event_type") == k, cents)), F.lit(0)).alias(f"c{i}") for i, k in enumerate(kinds)))


def raw_name() -> Column:
    n = F.col("event_id") % 20
    return F.when(n < 8, F.concat(F.lit("b:Bus:"), n)).when(n < 12, F.concat(F.lit("l:PowerLine:("), n - 8, F.lit(", "), n - 7, F.lit(", 0)"))).when(n < 16, F.concat(F.lit("x.child.1:PowerLoad:"), n)).otherwise(F.concat(F.lit("c:CHP:"), n))


def faults(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Failures (errors) or repairs (purchases): cp_density, experiment, id, step, node."""
    of = {"failure": "error", "repair": "purchase"}[kind]
    return _run(spark, sf_dir).where(F.col("event_type") == of).select("event_id", "cp_density", "experiment", "id", "step", raw_name().alias("node"), F.lit(kind).alias("type"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs have observed: performance as lists, faults as maps, and counts that are no rows."""
    p, f = perf(spark, sf_dir), [faults(spark, sf_dir, k) for k in ("failure", "repair")]
    seen = p.select("experiment", "id", F.lit("performance").alias("key"), F.col("step").alias("position"), F.to_json(F.array("c0", "c1", "c2")).alias("value"))
    told = f[0].unionByName(f[1]).select("experiment", "id", F.col("type").alias("key"), F.col("event_id").alias("position"), F.to_json(F.struct("step", "node", "type")).alias("value"))
    counts = p.groupBy("experiment", "id").agg(F.count("*").cast("string").alias("value")).select("experiment", "id", F.lit("steps").alias("key"), F.lit(0).cast("long").alias("position"), "value")
    return seen.unionByName(told).unionByName(counts)


def result_folders(spark: SparkSession, sf_dir: str) -> str:
    """The observations as folders of CSV files under the shared folder."""
    path = folder(spark, "results")
    folders.register(spark)
    folders.append(observations(spark, sf_dir), path)
    return path


def components(spark: SparkSession) -> DataFrame:
    """cp_density, node, type of twenty components at five densities."""
    n = F.col("id")
    key = F.when(n < 8, F.concat(F.lit("node:"), n)).when(n < 12, F.concat(F.lit("branch:("), n - 8, F.lit(", "), n - 7, F.lit(", 0)"))).when(n < 16, F.concat(F.lit("child:"), n)).otherwise(F.concat(F.lit("compound:"), n))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (n + 1).cast("int"))
    return spark.range(20).select(key.alias("node"), kind.alias("type"), F.explode(F.array(*(F.lit(d) for d in (0.0, 0.5, 1.0, 1.5, 2.0)))).alias("cp_density"))


def members(spark: SparkSession) -> DataFrame:
    """Children 12 to 15 sit at nodes 0 and 1."""
    return components(spark).where("node like 'child:%'").select("cp_density", F.col("node").alias("child"), F.concat(F.lit("node:"), F.split("node", ":")[1].cast("int") % 2).alias("node"), F.lit("Bus").alias("type"))


def metrics(spark: SparkSession) -> DataFrame:
    """Made-up whole-number metrics of the components."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", "node", F.col("cp_density").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return components(spark).select(F.col("node").alias("id"), "cp_density", "type", *((F.floor(n / k) % 1000).cast("double").alias(m) for k, m in ((1, "betweenness_centrality"), (7, "degree"), (49, "vc"), (343, "katz"))))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network_id, u, v, key, w: of each customer nation the two supplier nations it trades most with; w from mean discounts."""
    t = lambda name: table(spark, sf_dir, name)
    trade = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    cents = F.round(F.col("l_discount") * 100).cast("long")
    pairs = trade.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).agg(F.count("*").alias("n"), F.sum(cents).alias("d"))
    top = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("_r <= 2")
    w = F.floor(F.col("d") * 1000 / F.col("n")).cast("long") + 1
    both = top.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), w.alias("w"))
    return both.groupBy("u", "v").agg(F.min("w").alias("w")).select(F.lit(0).cast("long").alias("network_id"), "u", "v", F.lit(0).cast("long").alias("key"), "w")


def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network_id, id, nation: suppliers as nodes, one network for each region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("network_id"))
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey").select("network_id", F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("nation"))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """network_id, a, b, n: in how many parts suppliers a < b of a network meet, from rows network_id, part, id in that order; a pair comes once for each PAIRS or so."""
    left, found, held = [np.zeros(0, np.int64)] * 3, [], 0
    for batch in chain(batches, [None]):
        net, part, own = left if batch is None else (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(left))
        if not len(own):
            continue
        begins = np.append(True, (net[1:] != net[:-1]) | (part[1:] != part[:-1]))
        once = begins | np.append(True, own[1:] != own[:-1])
        net, part, own, group = net[once], part[once], own[once], np.cumsum(begins)[once]
        whole = len(own) if batch is None else int(np.searchsorted(group, group[-1]))  # the last part may go on
        left = [x[whole:] for x in (net, part, own)]
        at, away = np.arange(whole), 1
        while True:
            at = at[at + away < whole]
            at = at[group[at] == group[at + away]]
            if not len(at):
                break
            found.append((net[at], own[at], own[at + away]))
            held, away = held + len(at), away + 1
            if held >= PAIRS:
                yield from _counted(found)
                found, held = [], 0
    yield from _counted(found)


def _counted(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """network_id, a, b, n: how often each pair is there."""
    net, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    for network in np.unique(net):
        here = net == network
        ids, x, y = None, a[here], b[here]
        least, most = int(x.min()), int(y.max())  # a < b
        if most - least >= 1 << 31:
            ids = np.unique(np.concatenate([x, y]))
            x, y, least, most = np.searchsorted(ids, x), np.searchsorted(ids, y), 0, len(ids) - 1
        span = most - least + 1
        pair, n = np.unique((x - least) * span + (y - least), return_counts=True)
        ends = [e + least if ids is None else ids[e] for e in (pair // span, pair % span)]
        columns = (np.full(len(n), network), *ends, n)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["network_id", "a", "b", "n"])


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network_id, u, v, key, loss_percent: each supplier and the two of its region that supply most parts it does; larger tables make larger networks."""
    items = table(spark, sf_dir, "lineitem").where("l_partkey is not null").select(F.col("l_suppkey").cast("long").alias("id"), F.col("l_partkey").cast("long").alias("part"))
    # ranges of parts, not hashes: suppliers that meet at one part often meet at those beside it, and are counted before a row leaves the task
    sold = items.join(grid_nodes(spark, sf_dir), "id").select("network_id", "part", "id").repartitionByRange(_tasks(4 * items.count()), "part", "network_id")
    counts = stored(sold.sortWithinPartitions("network_id", "part", "id").mapInArrow(_together, "network_id long, a long, b long, n long"), "together")
    met = counts.repartition(_tasks(counts.count()), "network_id", "a", "b").groupBy("network_id", "a", "b").agg(F.sum("n").alias("n"))
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = met.select("network_id", F.explode(ends).alias("e"), "n").select("network_id", "e.a", "e.b", "n")
    top = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("network_id", "a").orderBy(F.desc("n"), "b"))).where("_r <= 2")
    key = F.when(F.col("a") < F.col("b"), 0).otherwise(1).cast("long")
    return top.select("network_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), key.alias("key"), ((1 + F.col("n") % 50) / 10).alias("loss_percent"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the regions' networks, weighted by losses in tenths of a percent; written once, as all that is made of them reads them often."""
    lost = stored(losses(spark, sf_dir), "losses")
    return stored(weighted(lost.drop("loss_percent"), lost, 10.0), "grids")


def grid_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, each at the first supplier of its nation."""
    at = grid_nodes(spark, sf_dir).groupBy("network_id", "nation").agg(F.min("id").alias("node_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    return c.join(at, "nation").select("network_id", "id", "node_id", F.lit("PowerLoad").alias("type"))


def grid_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations: all their suppliers are members, the first and the last are connected."""
    each = grid_nodes(spark, sf_dir).groupBy("network_id", F.col("nation").alias("id")).agg(F.min("id").alias("_a"), F.max("id").alias("_b"), F.sort_array(F.collect_list("id")).alias("members"))
    return each.select("network_id", "id", F.when(F.col("id") % 2 == 0, "CHP").otherwise("PowerToHeat").alias("type"), F.create_map(F.lit("a"), "_a", F.lit("b"), "_b").alias("connected_to"), "members")


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pi model on the edges, with an operating point."""
    w = F.col("w")
    e = edges(spark, sf_dir)
    branch = F.col("u") * 100 + F.col("v")
    ops = dict(vi=1.0 + (F.col("u") % 5) / 100.0, vj=1.0 + (F.col("v") % 5) / 100.0, theta_i=(F.col("u") % 7) / 100.0, theta_j=(F.col("v") % 7) / 100.0)
    return e.select("network_id", F.col("u").cast("int").alias("f"), F.col("v").cast("int").alias("t"), branch.alias("branch"), (w / 100000.0).alias("r"), (w / 20000.0).alias("x"), F.lit(0.0).alias("g_fr"), F.lit(0.01).alias("b_fr"), F.lit(0.0).alias("g_to"), F.lit(0.01).alias("b_to"), F.when(F.col("u") % 3 == 0, 0.0).otherwise(0.98).alias("tap"), F.lit(0.0).alias("shift"), *(c.alias(k) for k, c in ops.items()))


def grid_power(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Branches in use and numbered, typed buses of the regions' networks; an external grid is attached to each network's first node."""
    e, w = grids(spark, sf_dir) if e is None else e, F.col("w")
    model = e.select("network_id", F.col("u").alias("from_id"), F.col("v").alias("to_id"), ((F.col("u") * 100_000 + F.col("v")) * 2 + F.col("key")).alias("branch"), (w / 10000.0).alias("r"), (w / 2000.0).alias("x"), F.lit(0.0).alias("g_fr"), F.lit(0.01).alias("b_fr"), F.lit(0.0).alias("g_to"), F.lit(0.01).alias("b_to"), F.when(F.col("u") % 3 == 0, 0.0).otherwise(0.98).alias("tap"), ((w % 3) / 100.0).alias("shift"), F.lit(True).alias("active"), F.lit(1).alias("on_off"), F.lit("GenericPowerBranch").alias("type"))
    off = model.where("branch % 2 = 0").withColumns({"on_off": F.lit(0), "r": F.col("r") * 2})
    pipes = model.withColumn("type", F.lit("GasPipe"))
    k = F.col("id")
    placed = grid_nodes(spark, sf_dir).join(nodes(e), ["network_id", "id"])
    buses = placed.select("network_id", "id", ((k % 7) / 100.0).alias("theta"), (1.0 + (k % 5) / 100.0).alias("v"))
    external = placed.groupBy("network_id").agg(F.min("id").alias("node_id")).withColumn("type", F.lit("ExtPowerGrid"))
    loads = placed.select("network_id", F.col("id").alias("node_id"), F.lit("PowerLoad").alias("type"))
    return powerflow.numbered(model.union(off).union(pipes), buses, external.unionByName(loads))


def grid_transfers(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """network_id, s, t: from every bus of a region's network to the first bus of each of its nations."""
    placed = grid_nodes(spark, sf_dir).join(nodes(grids(spark, sf_dir) if e is None else e), ["network_id", "id"])
    place = placed.withColumn("idx", (F.row_number().over(Window.partitionBy("network_id").orderBy("id")) - 1).cast("long"))
    to = place.groupBy("network_id", "nation").agg(F.min("idx").alias("t"))
    return place.select("network_id", F.col("idx").alias("s")).join(to, "network_id").where("s <> t").select("network_id", "s", "t")


def hazard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components."""
    k = F.col("p_partkey")
    grid = F.when(k % 4 == 0, "power").when(k % 4 == 1, "gas").when(k % 4 == 2, "water")
    kind = F.when(k % 5 < 2, "node").when(k % 5 == 2, "branch").when(k % 5 == 3, "child").otherwise("compound")
    return table(spark, sf_dir, "part").select(k.alias("component_id"), kind.alias("kind"), lookup(PART_TYPES, F.col("p_type")).alias("type"), grid.alias("grid"), (k % 6 != 0).alias("independent"), (F.col("p_size") / 10.0).alias("coefficient"), F.col("p_retailprice").alias("nominal"))


def runs(spark: SparkSession, n: int = 3) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "run_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, hour, kw (whole cents): order totals by status, summed by day; hours are numbered from the first day."""
    o = table(spark, sf_dir, "orders")
    days = o.groupBy(F.col("o_orderstatus").alias("profile"), F.to_date("o_orderdate").alias("_day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("kw"))
    first = F.broadcast(o.agg(F.min(F.to_date("o_orderdate")).alias("_first")))  # one row
    return days.crossJoin(first).select("profile", F.datediff("_day", "_first").cast("long").alias("hour"), "kw")
