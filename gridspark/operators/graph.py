"""Network metrics: all networks in one job.

edges: network_id, u, v, key, w (positive whole numbers, so that equal paths are equal); undirected, parallel edges
are told apart by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalar import layer_shift
from gridspark.operators import walks
from gridspark.sources.shared import dropped, stored


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("network_id", F.col("u").alias("id")).union(edges.select("network_id", "v")).distinct()


def weighted(edges: DataFrame, losses: DataFrame, scale: float) -> DataFrame:
    """Edges with w from a table of losses (network_id, u, v, key, loss_percent): in whole units of 1 / scale, one at least.

    An edge without a known loss is left out, as no path over it has a length.
    """
    known = losses.where("loss_percent is not null and not isnan(loss_percent)").select("network_id", "u", "v", "key", F.greatest(F.round(F.col("loss_percent") * scale).cast("long"), F.lit(1)).alias("w"))
    return edges.join(known, ["network_id", "u", "v", "key"])


def degree(edges: DataFrame) -> DataFrame:
    """Edge ends at each node; a loop counts twice."""
    ends = edges.select("network_id", F.col("u").alias("id")).unionAll(edges.select("network_id", "v"))
    return ends.groupBy("network_id", "id").agg(F.count("*").alias("degree"))


def over_ends(edges: DataFrame, values: DataFrame, value: str, how: str) -> DataFrame:
    """Sum or mean of a node value over the two ends of each edge."""
    a = values.select("network_id", F.col("id").alias("u"), F.col(value).alias("_a"))
    b = values.select("network_id", F.col("id").alias("v"), F.col(value).alias("_b"))
    total = F.col("_a") + F.col("_b")
    return edges.join(a, ["network_id", "u"]).join(b, ["network_id", "v"]).select("network_id", "u", "v", "key", (total if how == "sum" else total / 2).alias(value))


def distances(edges: DataFrame) -> DataFrame:
    """network_id, s, t, d of all connected pairs of different nodes."""
    return walks.pair_table(edges).where("s <> t").select("network_id", "s", "t", "d")


def of_nodes(walked: DataFrame) -> DataFrame:
    """network_id, id, betweenness_centrality, vc of walks.walk().

    Betweenness is the share of shortest paths through a node, normalised by the number of pairs of others.  Vitality
    is how much the sum of all distances falls without the node; -infinity if it takes the network apart, and NaN for
    all nodes of a network that is not connected to begin with.
    """
    own = walked.where("v is null")
    whole = own.groupBy("network_id").agg((F.sum("total") / 2).alias("whole"), F.sum("reached").alias("pairs"))
    n, others = F.col("n"), (F.col("n") - 1) * (F.col("n") - 2)
    vc = F.when(F.col("pairs") < n * (n - 1), F.lit(math.nan)).when(F.col("parts"), F.lit(-math.inf)).otherwise(F.col("whole") - F.col("rest") / 2)
    return own.join(whole, "network_id").select("network_id", F.col("u").alias("id"), F.when(others > 0, F.col("through") / others).otherwise(0.0).alias("betweenness_centrality"), vc.alias("vc"))


def of_edges(walked: DataFrame) -> DataFrame:
    """network_id, u, v, key, betweenness_centrality of walks.walk(), normalised by the number of pairs."""
    n = walked.where("v is null").groupBy("network_id").agg(F.max("n").alias("_n"))
    return walked.where("v is not null").join(n, "network_id").select("network_id", "u", "v", "key", F.try_divide("through", F.col("_n") * (F.col("_n") - 1)).alias("betweenness_centrality"))


def betweenness(edges: DataFrame) -> DataFrame:
    return of_nodes(walks.walk(edges, vitality=False)).select("network_id", "id", "betweenness_centrality")


def edge_betweenness(edges: DataFrame) -> DataFrame:
    return of_edges(walks.walk(edges, vitality=False))


def vitality(edges: DataFrame) -> DataFrame:
    return of_nodes(walks.walk(edges)).select("network_id", "id", "vc")


def katz(edges: DataFrame, alpha: float = 0.1, beta: float = 1.0, scale: float = 1.0, tolerance: float = 1e-13, rounds: int = 60) -> DataFrame:
    """Katz centrality of the simple graph (of parallel edges the last one by key counts), weights w / scale, length 1.

    All networks are iterated together, x = alpha * A * x + beta by a join and a sum.  The state is written after every
    four steps, when the changes tell how much is left: in a symmetric graph their length falls by at least the same
    factor with every step, unless the sum over walks diverges, which is an error.
    """
    simple = edges.groupBy("network_id", "u", "v").agg((F.max_by("w", "key") / scale).alias("w"))
    same = simple.select("network_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.struct("u", "v").alias("_o"), "w").groupBy("network_id", "a", "b").agg(F.max_by("w", "_o").alias("w"))
    arcs = stored(same.union(same.where("a <> b").select("network_id", "b", "a", "w")), "arcs")
    everyone = nodes(edges)
    state = stored(everyone.withColumn("x3", F.lit(beta)), "katz")
    made = [state]
    for _ in range(rounds):
        x = state.select("network_id", "id", F.col("x3").alias("x"))
        steps = []
        for k in range(4):
            pulled = arcs.join(x.withColumnRenamed("id", "b"), ["network_id", "b"]).groupBy("network_id", F.col("a").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("_s"))
            x = pulled.select("network_id", "id", (beta + alpha * F.col("_s")).alias("x"))
            steps.append(x.withColumnRenamed("x", f"x{k}"))
        state = stored(steps[1].join(steps[2], ["network_id", "id"]).join(steps[3], ["network_id", "id"]), "katz")
        made.append(state)
        square = lambda c: F.sum(c * c)
        last, before = square(F.col("x3") - F.col("x2")), square(F.col("x2") - F.col("x1"))
        each = state.groupBy("network_id").agg(F.sqrt(last).alias("last"), F.sqrt(before).alias("before"), F.sqrt(square(F.col("x3"))).alias("norm"))
        shrink = F.try_divide("last", "before")
        # what is still to come is at most a geometric series of the last change
        left = F.when(F.col("last") <= tolerance * F.col("norm"), 0.0).when(shrink >= 1, F.lit(math.inf)).otherwise(F.col("last") * shrink / (1 - shrink) / F.col("norm"))
        worst = each.agg(F.max(left)).first()[0]
        dropped(*made[:-1])
        made = made[-1:]
        if worst == math.inf:
            raise ValueError("alpha is too large for a network: the sum over walks diverges")
        if worst is None or worst <= tolerance:
            break
    else:
        raise ValueError(f"no fixed point after {4 * rounds} steps")
    dropped(arcs)
    norm = state.groupBy("network_id").agg(F.sqrt(F.sum(F.col("x3") * F.col("x3"))).alias("_n"))
    return state.join(norm, "network_id").select("network_id", "id", (F.col("x3") / F.col("_n")).alias("katz"))


def group_betweenness(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of shortest paths between others that meet a group (network_id, group_id, members), by pairs of others.

    A path meets members of one island (walks.islands()) only, so groups are taken apart by islands.  Walks give the
    flow over each pair of members (paths that meet one and then the other); then members are added one by one, and
    each takes the paths that it meets from what is left for the others.  Members that the network lacks are passed over.
    """
    names, cut = ["network_id", "group_id"], walks.islands(edges)
    place = cut.select("network_id", "island", F.size("ids").alias("c"), F.explode("ids").alias("m"))
    member = groups.select(*names, F.explode(F.array_distinct("members")).alias("m")).join(place, ["network_id", "m"])
    apart = stored(member.groupBy(*names, "island").agg(F.array_sort(F.collect_list("m")).alias("m"), F.first("c").alias("c")), "members")
    pairs = walks.member_paths(cut, apart.select(*names, "island", "m"))
    cells = pairs.groupBy(*names, "island").agg(F.array_sort(F.collect_list(F.struct("x", "y", "d", "p", "flow"))).alias("cells")).select(*names, "cells")
    # pairs of which one end at least is in the group do not count
    k = F.size("m").cast("long")
    ends = apart.groupBy(*names).agg(F.sum(k * (F.col("c") - 1)).alias("reached"), F.sum(k).alias("k"), F.sum(k * (k - 1)).alias("inner"))
    size = cut.select("network_id", "n").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_joints(batch.column(2)), pa.float64())], names=[*names, "met"])

    joint = cells.mapInArrow(run, "network_id long, group_id long, met double").groupBy(*names).agg(F.sum("met").alias("met"))
    found = joint.join(ends, names).join(size, "network_id")
    others = (F.col("n") - F.col("k")) * (F.col("n") - F.col("k") - 1)
    between = F.col("met") - (2 * F.col("reached") - F.col("inner"))
    none = groups.join(found, names, "left_anti").join(size, "network_id").select(*names, F.lit(0.0))
    return found.select(*names, F.when(others > 0, between / others).otherwise(0.0).alias("betweenness_centrality")).union(none)


def _joints(cells: pa.ListArray) -> list[float]:
    """_joint() of each list of cells, of which no more than one is copied at a time."""
    at, columns = cells.offsets.to_numpy(), [c.to_numpy(zero_copy_only=False) for c in cells.values.flatten()]
    return [_joint(np.stack([c[a:z] for c in columns], 1, dtype=float, casting="same_kind")) for a, z in zip(at[:-1], at[1:], strict=True)]


def _joint(cells: np.ndarray) -> float:
    """The share of pairs whose paths meet any member; cells: x, y, distance, paths and flow of all pairs of members that are connected."""
    ids = np.unique(cells[:, 0])
    k = len(ids)
    d, p, flow = np.full((k, k), np.inf), np.zeros((k, k)), np.zeros((k, k))
    at = tuple(np.searchsorted(ids, cells[:, c]) for c in (0, 1))
    d[at], p[at], flow[at] = cells[:, 2], cells[:, 3], np.nan_to_num(cells[:, 4])
    met = 0.0

    def share(a: np.ndarray, b: np.ndarray, whole: np.ndarray, on: np.ndarray) -> np.ndarray:
        good = on & (whole > 0)
        return np.where(good, a * b / np.where(good, whole, 1), 0.0)

    for v in range(k):
        met += flow[v, v]
        to, back = d[:, v][:, None], d[v][None]
        p_to, p_back = p[:, v][:, None], p[v][None]
        inside = share(p_to, p_back, p, (d == to + back) & np.isfinite(d))  # of the paths from x to y those that meet v
        before = share(p, p[:, v][None], p_to, (to == d + d[:, v][None]) & np.isfinite(to))  # of those from x to v those that meet y
        after = share(p_back.T, p, p_back, (back == d[v][:, None] + d) & np.isfinite(back))  # of those from v to y those that meet x
        rest = flow * (1 - inside)
        keep_y, keep_x = np.arange(k)[None] != v, np.arange(k)[:, None] != v
        rest = rest - np.where(keep_y, flow[:, v][:, None] * before, 0) - np.where(keep_x, flow[v][None] * after, 0)
        p, flow = p * (1 - inside), rest
    return met


def metrics_table(edges: DataFrame, children: DataFrame, compounds: DataFrame, scale: float) -> DataFrame:
    """network_id, id, type and the four metrics of nodes, children, edges and compounds.

    children: network_id, id, node_id, type; compounds: network_id, id, type, connected_to (map to nodes),
    members (nodes).  Edges have the sum of degrees and the means of the others, compounds likewise over
    what they connect, children what their node has.
    """
    keys, names = ["network_id", "id"], ["betweenness_centrality", "degree", "vc", "katz"]
    edges = stored(edges, "edges")  # they are read several times, and may be dear to make
    walked = stored(walks.walk(edges), "walked")  # one walk of each source gives what nodes and edges have
    own = stored(degree(edges).join(of_nodes(walked), keys).join(katz(edges, scale=scale), keys), "measures")
    node = own.select("network_id", F.concat(F.lit("node:"), "id").alias("id"), F.lit("Bus").alias("type"), *names)
    child = children.join(own.withColumnRenamed("id", "node_id"), ["network_id", "node_id"]).select("network_id", F.concat(F.lit("child:"), "id").alias("id"), "type", *names)
    at = [own.select("network_id", F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in names[1:])) for end in ("u", "v")]
    both = of_edges(walked).join(at[0], ["network_id", "u"]).join(at[1], ["network_id", "v"])
    ends = both.withColumns({"degree": F.col("degree_u") + F.col("degree_v"), "vc": (F.col("vc_u") + F.col("vc_v")) / 2, "katz": (F.col("katz_u") + F.col("katz_v")) / 2})
    branch = ends.select("network_id", F.format_string("branch:(%d, %d, %d)", "u", "v", "key").alias("id"), F.lit("GenericPowerBranch").alias("type"), *names)
    linked = compounds.select(*keys, "type", F.explode(F.map_values("connected_to")).alias("node_id")).join(own.withColumnRenamed("id", "node_id"), ["network_id", "node_id"])
    grouped = linked.groupBy(*keys, "type").agg(F.sum("degree").alias("degree"), F.avg("vc").alias("vc"), F.avg("katz").alias("katz"))
    shares = group_betweenness(edges, compounds.select("network_id", F.col("id").alias("group_id"), "members")).withColumnRenamed("group_id", "id")
    compound = grouped.join(shares, keys).select("network_id", F.concat(F.lit("compound:"), "id").alias("id"), "type", *names)
    return node.unionByName(child).unionByName(branch).unionByName(compound)


def network_frame(edges: DataFrame, places: DataFrame, values: DataFrame) -> DataFrame:
    """Segments of a network chart: the ends' places and the edge's value between 0 and 1, 0 where it has none."""
    a = places.select("network_id", F.col("id").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = places.select("network_id", F.col("id").alias("v"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    out = edges.select("network_id", "u", "v", "key").join(a, ["network_id", "u"]).join(b, ["network_id", "v"]).join(values, ["network_id", "u", "v", "key"], "left").fillna(0, ["value"])
    span = out.groupBy("network_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    color = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return out.join(span, "network_id").select("network_id", "u", "v", "key", "x0", "y0", "x1", "y1", color.alias("color"))


def layered(places: DataFrame) -> DataFrame:
    """Places (x, y, grid) moved by the shift of their layer, so that layers do not hide each other."""
    dx, dy = layer_shift(F.col("grid"))
    return places.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def network_points(places: DataFrame, values: DataFrame) -> DataFrame:
    """Points of a network chart: network_id, id, x, y, class, color, text.

    places: network_id, id, x, y, grid, grid_type, model, independent; values: network_id, id, value.  A node
    without a value has 0.  Dependent nodes are of class cp, others of the class that their grid's type names;
    nodes of other grids are not drawn.
    """
    joined = layered(places).join(values.select("network_id", "id", "value"), ["network_id", "id"], "left").fillna(0, ["value"])
    kind = F.when(~F.col("independent"), "cp")
    for part, name in (("Water", "heat"), ("Gas", "gas"), ("Power", "power")):
        kind = kind.when(F.col("grid_type").contains(part), name)
    text = F.concat_ws(" - ", "grid_type", "model", F.col("value").cast("string"))
    return joined.select("network_id", "id", "x", "y", kind.alias("class"), F.col("value").alias("color"), text.alias("text")).where("class is not null")
