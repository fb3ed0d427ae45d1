"""Toxicity score by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, word pairs, word triples and pairs that skip one
or two words.  Training visits one text after the other with a learning rate per coordinate; the L1 term
leaves few weights that are not 0, which is all that is broadcast.  Many labelled texts are dealt to parts,
which are visited side by side, and the parts' weights are averaged.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, binary_view, fold, give_back, grams, lean, sized, slices, tuned, words
from gridspark.llm.quality import labelled

BITS = 20
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
SCALE = 2.0**40
INTERCEPT, PARTS, TEXTS = -1, -2, -3


def buckets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and skip-grams within rows, and the row of each."""
    row, shift = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.uint64(64 - BITS)
    ids, rows = [], []
    for shape in SHAPES:
        g, last = grams(h, shape), max(shape)
        if len(g):
            own = row[: len(g)] == row[last:]
            ids.append((g[own] >> shift).astype(np.int32))
            rows.append(row[: len(g)][own])
    return (np.concatenate(ids), np.concatenate(rows)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class Ftrl:
    """Weights of buckets; the last one is the intercept, which has no L1 term.

    A visit moves z by less than 1 as long as the weight is 0, and a weight leaves 0 only where z is beyond l1.
    So a bucket that fewer than ``least`` texts have keeps the weight 0 whatever the others do, and may be left out.
    """

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 4) -> None:
        self.alpha, self.beta, self.l1, self.l2, self.epochs, self.least = alpha, beta, l1, l2, epochs, int(l1 // epochs) + 1
        self.index, self.weight, self.bias, self.fitted = np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, False
        self.texts = 0

    def fit(self, rows: Sequence[np.ndarray], labels: Sequence[float], seed: int = 7) -> Ftrl:
        size = 1 << BITS
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        l1 = np.full(size + 1, self.l1)
        l1[size] = 0
        rng = np.random.default_rng(seed)
        seen = np.zeros(size, np.int32)
        for x in map(unpacked, rows):
            seen[x] += 1
        rows = [x if (seen[unpacked(x)] >= self.least).all() else packed(unpacked(x)[seen[unpacked(x)] >= self.least]) for x in rows]  # the others' weights stay 0

        def weights(i: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z[i]) > l1[i], (np.sign(z[i]) * l1[i] - z[i]) / ((self.beta + np.sqrt(n[i])) / self.alpha + self.l2), 0.0)

        for _ in range(self.epochs):
            for k in rng.permutation(len(rows)):
                i = np.append(unpacked(rows[k]), size)
                w = weights(i)
                p = 1 / (1 + np.exp(-min(max(w.sum(), -35.0), 35.0)))
                g = p - labels[k]
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / self.alpha
                z[i] += g - sigma * w
                n[i] += g * g
        w = weights(np.arange(size + 1))
        self.bias = float(w[size])
        self.index = np.flatnonzero(w[:size]).astype(np.int32)
        self.weight = w[self.index].astype(np.float32)
        self.texts, self.fitted = len(rows), len(rows) > 0
        return self

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def packed(x: np.ndarray) -> np.ndarray:
    """Sorted buckets as the steps between them, in 16 bits if all of them fit."""
    steps = np.diff(x, prepend=0)
    return steps.astype(np.uint16) if len(x) and steps.max() < 1 << 16 else x


def unpacked(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int32) if x.dtype == np.uint16 else x


def logits(column: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    data, at = binary_view(column)
    out = np.full(len(column), bias)
    for a, z in slices(at):
        _, _, h, first = words(data, at[a : z + 1])
        ids, rows = buckets(h, first)
        hit = dense[ids] != 0
        pairs = np.unique(rows[hit] << BITS | ids[hit])
        out[a:z] += np.bincount(pairs >> BITS, dense[pairs & (1 << BITS) - 1], z - a)
    return out


def _features(batch: pa.RecordBatch) -> dict:
    data, at = binary_view(batch.column(1))
    found: list[np.ndarray] = []
    for a, z in slices(at):
        _, _, h, first = words(data, at[a : z + 1])
        ids, rows = buckets(h, first)
        pairs = np.unique(rows << BITS | ids)
        found += map(packed, np.split((pairs & (1 << BITS) - 1).astype("<i4"), np.searchsorted(pairs >> BITS, np.arange(1, z - a))))
    wide = pa.array([x.dtype != np.uint16 for x in found], pa.bool_())
    return {"doc_id": batch.column(0), "label": batch.column(2).cast(pa.float64()), "x": pa.array([x.tobytes() for x in found], pa.binary()), "wide": wide}


def _fitted_part(table: pa.Table) -> pa.Table:
    """Weights of a model of these texts, its intercept, and how many parts (one) and texts they are of; in whole steps of 1 / SCALE, so that sums don't depend on their order."""
    table = table.sort_by("doc_id")
    rows = [np.frombuffer(x.as_buffer(), "<i4" if wide.as_py() else "<u2") for x, wide in zip(table["x"], table["wide"], strict=True)]
    model = Ftrl().fit(rows, table["label"].to_numpy())
    weight = np.round(np.append(model.weight.astype(np.float64), model.bias) * SCALE).astype(np.int64)
    out = pa.table({"bucket": np.concatenate([model.index, [INTERCEPT, PARTS, TEXTS]]).astype(np.int64), "value": np.append(weight, [1, len(rows)])})
    del table, rows, model
    give_back()
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, size: int = 48 << 20) -> Ftrl:
    """Fitted on all labelled texts that aren't held out; without any, all scores are 0.5.

    The texts are dealt by their ids to parts of about ``most`` texts, or of ``size`` bytes if that makes more parts.  A
    task visits all texts of a part, and the weights are the means of those of the parts: a model of each part under
    the same L1 term, of which the driver gets no more than a sum for each bucket.
    An id counts once, however often it is repeated; if it has several texts, the one of least packed features stands for it.
    """
    chosen = docs.select("doc_id", "text").join(sized(labelled(labels, "toxic", 0, 5), 1_000_000), "doc_id")
    sizes = chosen.groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-n // most), -(-total // size))
    made = arrow_map(chosen.select("doc_id", "text", "_label"), _features, "doc_id long, label double, x binary, wide boolean")
    width = max(2 * parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so that few parts meet in a task
    made = made.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).repartition(width, "part")  # the only shuffle of features
    one = made.groupBy("part", "doc_id").agg(F.max("label").alias("label"), F.min(F.struct("x", "wide")).alias("x"))
    fitted = one.select("part", "doc_id", "label", "x.x", "x.wide").groupBy("part").applyInArrow(_fitted_part, "bucket long, value long")
    table = fitted.groupBy("bucket").agg(F.sum("value").alias("value")).orderBy("bucket").toArrow()  # at most 2 ** BITS + 3 rows
    bucket, value = table["bucket"].to_numpy(), table["value"].to_numpy()
    model, seen = Ftrl(), dict(zip(bucket[bucket < 0].tolist(), value[bucket < 0].tolist(), strict=True))
    if seen:
        mean = value[bucket >= 0] / (SCALE * seen[PARTS])
        model.index, model.weight = bucket[bucket >= 0].astype(np.int32), mean.astype(np.float32)
        model.bias, model.texts, model.fitted = seen[INTERCEPT] / (SCALE * seen[PARTS]), seen[TEXTS], True
    return model


def score(docs: DataFrame, model: Ftrl, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts get the intercept's score; repeated rows are kept; an empty table gives no rows;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        if not hasattr(m, "_dense"):
            m._dense = m.dense()
        s = 1 / (1 + np.exp(-np.clip(logits(batch.column(2), m._dense, m.bias), -30, 30)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= threshold).astype("i4")}

    return arrow_map(docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Ftrl, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold; all rows if the model was fitted on none."""
    if not model.fitted:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        if not hasattr(m, "_dense"):
            m._dense = m.dense()
        for batch in batches:
            s = 1 / (1 + np.exp(-np.clip(logits(batch.column(at), m._dense, m.bias), -30, 30)))
            yield batch.filter(pa.array(s < threshold))

    tuned(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)
