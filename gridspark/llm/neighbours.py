"""Nearest vectors by inner product: a forest of random-projection trees, searched through one priority queue.

Vectors get one more component that makes all of them equally long; queries have 0 there and are as long.  Then the
largest inner product is the smallest angle, and trees that halve the vectors by random directions apply.  Trees are
fitted on a bounded sample, all vectors are put into their leaves.  A query's queue holds branches of all trees by how
far they are beyond the boundaries that part them from the query; the leaves that leave it first are its candidates,
as many as the sample shows to be needed for the recall that is asked for.

Leaves are gathered to places of bounded size, and a leaf with more vectors is dealt over several places, so no task
grows with a leaf.  At a place all candidates get their exact inner products, the best of each query leave it, and the
best of all places are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import lean, mix, tuned

#: Vectors that meet at one place, and queries that are looked at there together.
PLACE, BLOCK = 8192, 256
#: Rows whose margins to all nodes are in memory at once.
ROWS = 2048
#: Answers that a task keeps to merge those of its places, before it hands them on.
ANSWERS = 400_000
Answers = tuple[np.ndarray, np.ndarray, np.ndarray]


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``width`` finite components, not all of them 0, and those as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == width)
    rows = np.flatnonzero(whole)
    values = column.values.to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
    x = values[offsets[:-1][rows][:, None] + np.arange(width)]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about 2 * ROWS rows, whatever the session's are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions, without overflow of squares."""
    top = np.abs(x).max(1, initial=0)[:, None]
    unit = x / top
    size = np.sqrt((unit * unit).sum(1))[:, None]
    return (top * size)[:, 0], unit / size


@dataclass
class Forest:
    """Trees of equal depth: node k has the children 2k + 1 (below the cut) and 2k + 2; leaves are numbered through all trees."""

    planes: np.ndarray  # tree, node, component
    cuts: np.ndarray  # tree, node
    depth: int
    longest: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        size, unit = norms(x)
        share = np.minimum(size / self.longest, 1.0)[:, None]
        return np.hstack([unit * share, np.sqrt(1 - share * share)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """How far above the cut of each node of each tree: row, tree, node."""
        trees, nodes, width = self.planes.shape
        return (x @ self.planes.reshape(-1, width).T).reshape(len(x), trees, nodes) - self.cuts

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        if len(x) > ROWS:
            return np.concatenate([self.leaves(x[a : a + ROWS]) for a in range(0, len(x), ROWS)])
        trees = len(self.planes)
        node, row, tree = np.zeros((len(x), trees), np.int64), np.arange(len(x))[:, None], np.arange(trees)[None]
        above = self.margins(self.lifted(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (above[row, tree, node] >= 0)
        return node - ((1 << self.depth) - 1) + tree * (1 << self.depth)

    def search(self, x: np.ndarray, size: np.ndarray, enough: float) -> Iterator[list[int]]:
        """For each query the leaves nearest first, until they hold ``enough`` vectors (size: of each leaf)."""
        above = self.margins(np.hstack([norms(x)[1], np.zeros((len(x), 1))]))
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        for margin in above.tolist() if self.depth else [[[]] * len(self.planes)] * len(x):
            queue = [(0.0, tree, 0) for tree in range(len(margin))]
            held, out = 0, []
            while queue and held < enough:
                far, tree, node = heapq.heappop(queue)
                while node < inner:
                    m = margin[tree][node]
                    heapq.heappush(queue, (far + m * m, tree, 2 * node + 1 + (m < 0)))
                    node = 2 * node + 1 + (m >= 0)
                out.append(tree * leaves + node - inner)
                held += size[out[-1]]
            yield out


def grow(sample: np.ndarray, longest: float, trees: int, leaf: int, seed: int) -> Forest:
    """Trees that halve the sample at medians along random directions, until leaves have about ``leaf`` rows of it."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
    rng, nodes = np.random.default_rng(seed), (1 << depth) - 1
    planes = rng.standard_normal((trees, nodes, sample.shape[1] + 1))
    planes /= np.sqrt((planes * planes).sum(2, keepdims=True))
    forest = Forest(planes, np.zeros((trees, nodes)), depth, longest)
    x = forest.lifted(sample)
    for tree in range(trees):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, along = (1 << level) - 1, (x * planes[tree, node]).sum(1)
            order = np.lexsort((along, node))
            begin = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
            filled = begin[:-1] < begin[1:]  # many equal vectors can leave a branch without any
            median = along[order[np.minimum((begin[:-1] + begin[1:]) // 2, len(x) - 1)]]
            forest.cuts[tree, first : 2 * first + 1] = np.where(filled, median, 0.0)
            node = 2 * node + 1 + (along >= forest.cuts[tree, node])
    return forest


def needed(forest: Forest, sample: np.ndarray, k: int, recall: float, seed: int, queries: int = 256) -> float:
    """The share of all vectors that leaves must hold (each tree's count), so that this much of the sample's true nearest are in them."""
    trees, n = len(forest.planes), len(sample)
    if n < 2 or not forest.depth:
        return float(trees)
    asked = np.random.default_rng(seed).permutation(n)[:queries]
    leaves = forest.leaves(sample)
    size = np.bincount(leaves.ravel(), minlength=trees << forest.depth)
    found = []
    for a, order in zip(asked, forest.search(sample[asked], size, np.inf), strict=True):
        scores = sample @ sample[a]
        scores[a] = -np.inf
        near = np.argpartition(scores, -min(k, n - 1))[-min(k, n - 1) :]
        held = np.zeros(len(size))
        held[order] = np.cumsum(size[order])
        found.append(held[leaves[near]].min(1))
    return float(np.quantile(np.concatenate(found), recall)) / n


def _stats(rows: DataFrame) -> tuple[int, int, float]:
    """The commonest number of components (of equally common ones the largest), vectors that have it, the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            column = batch.column(1)
            for width in np.unique(np.diff(column.offsets.to_numpy())).tolist():
                if width:
                    _, x = usable(column, width)
                    yield pa.RecordBatch.from_pydict({"width": [width], "rows": [len(x)], "longest": [float(norms(x)[0].max(initial=0))]})

    each = rows.mapInArrow(lean(run), "width long, rows long, longest double").where("rows > 0")
    first = each.groupBy("width").agg(F.sum("rows").alias("rows"), F.max("longest").alias("longest")).orderBy(F.desc("rows"), F.desc("width")).first()
    return (first.width, first.rows, first.longest) if first else (0, 0, 0.0)


def _sample(rows: DataFrame, width: int, n: int, most: int) -> np.ndarray:
    """About ``most`` vectors, chosen by a hash of their ids (at most twice as many), in an order that partitions do not change."""
    share = min(1.0, most / max(n, 1))
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    chosen = rows if share == 1.0 else rows.where(hashed).limit(2 * most)
    table = chosen.toArrow()
    if not len(table):
        return np.zeros((0, width))
    kept, x = usable(table.column(1), width)
    return x[np.lexsort((*x.T[::-1], table.column(0).to_numpy()[kept]))]


def _places(size: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of places of each leaf: neighbours in a tree share one until it is full, a large leaf has several."""
    first, parts = np.zeros(len(size), np.int64), np.maximum(1, -(-size // PLACE))
    place, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k and (parts[k] > 1 or parts[k - 1] > 1 or held + n > PLACE or k % leaves == 0):
            place, held = place + int(parts[k - 1]), 0
        first[k] = place
        held += n
    return first, parts


def nearest(rows: DataFrame, every: int = 20, k: int = 20, trees: int = 4, leaf: int = 128, sample: int = 32_768, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found of each query (vec_id divisible by ``every``), nearest first.

    score is the inner product in double precision; equal ones go by the smaller vec_id.  A query's own id is no
    candidate.  Vectors that are null, zero or hold null or non-finite components take no part, nor do those without
    an id or with another number of components than the commonest.  A repeated id counts once, with its best score.
    Trees and the number of leaves to look into are fitted on about ``sample`` vectors and there hold ``recall`` of the
    true nearest; a query looks at (k + 1) * trees vectors at least.  An empty table gives no rows; other columns are not read.
    """
    tuned(rows.sparkSession)
    spark = rows.sparkSession
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width, n, longest = _stats(rows)
    kind = np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = _sample(rows, width, n, sample)
    forest = grow(chosen, longest, trees, leaf, seed)
    enough = max(needed(forest, chosen, k, recall, seed) * n, (k + 1) * trees)
    shared = spark.sparkContext.broadcast(forest)  # at most sample / leaf nodes in each tree

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(trees << shared.value.depth, np.int64)
        for batch in gathered(batches):
            _, x = usable(batch.column(1), width)
            size += np.bincount(shared.value.leaves(x).ravel(), minlength=len(size))
        yield pa.RecordBatch.from_pydict({"leaf": np.flatnonzero(size), "n": size[size > 0]})

    size = np.zeros(trees << forest.depth, np.int64)
    for r in rows.mapInArrow(lean(counted), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf
        size[r.leaf] = r.n
    first, parts = _places(size, 1 << forest.depth)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in gathered(batches):
            kept, x = usable(batch.column(1), width)
            ids = batch.column(0).to_numpy()[kept]
            vector = [v.tobytes() for v in x.astype(kind)]
            leaves = forest.leaves(x)
            lane = (mix(ids.astype(np.uint64))[:, None] % parts[leaves].astype(np.uint64)).astype(np.int64)
            out = [(p, False, i, v, [f]) for ps, fs, i, v in zip((first[leaves] + lane).tolist(), leaves.tolist(), ids.tolist(), vector, strict=True) for p, f in zip(ps, fs, strict=True)]
            asks = np.flatnonzero(ids % every == 0)
            for a, probes in zip(asks.tolist(), forest.search(x[asks], size, enough), strict=True):
                at: dict[int, list[int]] = {}
                for f in probes:
                    for p in range(first[f], first[f] + parts[f]):
                        at.setdefault(p, []).append(f)
                out += [(p, True, int(ids[a]), vector[a], fs) for p, fs in at.items()]
            for a in range(0, len(out), 4096):
                place, asking, i, v, fs = zip(*out[a : a + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(asking, pa.bool_()), pa.array(i, pa.int64()), pa.array(v, pa.binary()), pa.array(fs, pa.list_(pa.int32()))], names=["place", "asking", "id", "vector", "leaves"])

    made = rows.mapInArrow(lean(dealt), "place long, asking boolean, id long, vector binary, leaves array<int>").repartition("place").sortWithinPartitions("place", "asking")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, members, asked = None, None, []
        held: list[tuple[int, bytes, int]] = []
        answers = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), _merged(answers, k), strict=True)))

        for batch in batches:
            if len(answers[0]) > ANSWERS:
                answers = _merged(answers, k)
                if len(answers[0]) > ANSWERS // 2:
                    yield given()
                    answers = tuple(a[:0] for a in answers)
            for place, asking, i, v, fs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != here:
                    if asked:
                        answers = _with(answers, _best(members, asked, k, kind))
                    here, members, asked, held = place, None, [], []
                if not asking:
                    held.append((i, v, fs[0]))
                    continue
                if members is None:
                    members = _Members(held, kind)
                    held = []
                asked.append((i, v, fs))
                if len(asked) == BLOCK:
                    answers = _with(answers, _best(members, asked, k, kind))
                    asked = []
        if asked:
            answers = _with(answers, _best(members, asked, k, kind))
        yield given()

    found = made.mapInArrow(lean(met), "query_id long, vec_id long, score double").repartition("query_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Members:
    """The vectors of a place, leaf by leaf."""

    def __init__(self, held: list[tuple[int, bytes, int]], kind: type) -> None:
        held.sort(key=lambda m: (m[2], m[0]))
        self.ids = np.array([m[0] for m in held], np.int64)
        self.x = np.frombuffer(b"".join(m[1] for m in held), kind).reshape(len(held), -1).astype(float) if held else np.zeros((0, 0))
        leaf = np.array([m[2] for m in held], np.int64)
        names, begin = np.unique(leaf, return_index=True)
        self.repeated = len(np.unique(self.ids)) < len(self.ids)
        self.spans = dict(zip(names.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(leaf)], strict=True), strict=True))


def _best(members: _Members, asked: list[tuple[int, bytes, list[int]]], k: int, kind: type) -> Answers:
    """Query, vector and score of the k best of each query among the members of its leaves; those that could be among them are computed once more, all in one way."""
    q = np.frombuffer(b"".join(a[1] for a in asked), kind).reshape(len(asked), -1).astype(float)
    scores = np.full((len(asked), len(members.ids)), -np.inf)
    by: dict[int, list[int]] = {}
    for r, (_, _, leaves) in enumerate(asked):
        for f in leaves:
            by.setdefault(f, []).append(r)
    for f, rows in by.items():
        if f in members.spans:
            a, b = members.spans[f]
            scores[rows, a:b] = q[rows] @ members.x[a:b].T
    scores[np.array([a[0] for a in asked])[:, None] == members.ids] = -np.inf
    out: list[list[np.ndarray]] = [[], [], []]
    for r, (i, _, _) in enumerate(asked):
        least = np.partition(scores[r], -k)[-k] if scores.shape[1] > k and not members.repeated else -np.inf
        slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0.0
        near = np.flatnonzero((scores[r] >= least - slack) & (scores[r] > -np.inf))
        exact = (members.x[near] * q[r]).sum(1)
        order = np.lexsort((members.ids[near], -exact))
        if members.repeated:
            order = order[np.sort(np.unique(members.ids[near[order]], return_index=True)[1])]
        order = order[:k]
        top = near[order]
        out[0].append(np.full(len(top), i))
        out[1].append(members.ids[top])
        out[2].append(exact[order])
    return tuple(map(np.concatenate, out))


def _with(a: Answers, b: Answers) -> Answers:
    return tuple(np.concatenate(x) for x in zip(a, b, strict=True))


def _merged(answers: Answers, k: int) -> Answers:
    """The k best of each query, each vector once."""
    query, vector, score = (a[np.lexsort((-answers[2], answers[1], answers[0]))] for a in answers)
    new = np.append(True, (query[1:] != query[:-1]) | (vector[1:] != vector[:-1]))[: len(query)]
    query, vector, score = query[new], vector[new], score[new]
    order = np.lexsort((vector, -score, query))
    query, vector, score = query[order], vector[order], score[order]
    first = np.searchsorted(query, query)
    best = np.arange(len(query)) - first < k
    return query[best], vector[best], score[best]
