"""Quality score of a text by a generalised additive model with pairwise interactions.

Features are shares and ratios of a text's bytes, words and lines.  Training boosts shallow histogram
trees cyclically, one feature after the other, which sum up to one lookup table per feature; then pairs
with the largest gain on what is left get two-dimensional tables in the same way.  A score is the sum of
the tables' entries, found by bin, put through the logistic function.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, binary_view, fold, slices, token_hashes, words

FEATURES = ("log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "pipes", "shouts", "stops", "commas", "breaks", "distinct", "adjacent", "beyond_ascii", "top_word", "short_words", "repeated_lines", "long_words")
_UPPER, _LETTER, _DIGIT, _SYMBOL, _PIPE, _SHOUT, _STOP, _COMMA, _BREAK, _BEYOND, _REST = range(11)
_KIND = np.full(256, _REST, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LETTER, _DIGIT, _BEYOND
for _marks, _kind in ((b"#$%&*@^~<>{}[]\\_=+`", _SYMBOL), (b"|", _PIPE), (b"!?", _SHOUT), (b".", _STOP), (b",;:", _COMMA), (b"\n", _BREAK)):
    _KIND[list(_marks)] = _kind


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text; nulls are empty texts."""
    data, at = binary_view(column)
    out = np.zeros((len(column), len(FEATURES)))
    for a, z in slices(at):
        own, rows = at[a : z + 1], z - a
        raw, size = data[own[0] : own[-1]], np.diff(own)
        kinds = np.bincount(np.repeat(np.arange(rows) * 16, size) + _KIND[raw], minlength=rows * 16).reshape(rows, 16)
        start, end, h, first = words(data, own)
        n = np.diff(first)
        length = end - start
        row = np.repeat(np.arange(rows), n)
        per = np.maximum(n, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        distinct, top, repeated = np.zeros(rows), np.zeros(rows), np.zeros(rows)
        line_ends = np.union1d(np.flatnonzero(raw == 10), own[1:] - own[0])
        line_starts = np.concatenate([[0], line_ends[:-1]]) if len(line_ends) else line_ends
        full = line_ends - line_starts > 1
        line_starts, line_ends = line_starts[full], line_ends[full]
        line_starts = line_starts + (raw[line_starts] == 10)
        lines = token_hashes(raw, line_starts, line_ends)
        line_first = np.searchsorted(line_starts, own - own[0])
        for i in range(rows):
            if n[i]:
                found = np.sort(h[first[i] : first[i + 1]])
                edges = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]]))
                distinct[i], top[i] = len(edges) - 1, np.diff(edges).max()
                mine = lines[line_first[i] : line_first[i + 1]]
                repeated[i] = 1 - len(set(mine.tolist())) / max(1, len(mine))
        letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LETTER], 1)
        byte = np.maximum(size, 1)
        out[a:z] = np.stack(
            [np.log1p(n), np.log1p(size), np.bincount(row, length, rows) / per, kinds[:, _UPPER] / letters, kinds[:, _DIGIT] / byte, kinds[:, _SYMBOL] / per, kinds[:, _PIPE] / per, kinds[:, _SHOUT] / per, kinds[:, _STOP] / per, kinds[:, _COMMA] / per, kinds[:, _BREAK] / per, distinct / per, np.bincount(row, same, rows) / per, kinds[:, _BEYOND] / byte, top / per, np.bincount(row, length <= 3, rows) / per, repeated, np.bincount(row, length >= 20, rows) / per],
            axis=1,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class PairwiseGam:
    """Lookup tables over binned features and over pairs of them."""

    def __init__(self, bins: int = 48, pair_bins: int = 12, rounds: int = 120, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 1.0, least: float = 2.0) -> None:
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.ridge, self.least = bins, pair_bins, rounds, pairs, pair_rounds, rate, ridge, least

    def _cuts(self, x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)

    def _step(self, g: np.ndarray, h: np.ndarray, axis_splits: int) -> np.ndarray:
        """Leaf values by bin of a tree over ordered bins with that many levels of splits."""
        if axis_splits and len(g) > 1:
            cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            tg, th = g.sum(), h.sum()
            gain = cg**2 / (ch + self.ridge) + (tg - cg) ** 2 / (th - ch + self.ridge)
            gain[(ch < self.least) | (th - ch < self.least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > tg**2 / (th + self.ridge) + 1e-9:
                return np.concatenate([self._step(g[: k + 1], h[: k + 1], axis_splits - 1), self._step(g[k + 1 :], h[k + 1 :], axis_splits - 1)])
        return np.full(len(g), -g.sum() / (h.sum() + self.ridge))

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        n, m = x.shape
        p = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(p / (1 - p)))
        self.cuts = [self._cuts(x[:, j], self.bins) for j in range(m)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list = []
        if n == 0 or y.min() == y.max():
            return self
        at = [np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)]
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            for j in range(m):
                q = _sigmoid(f)
                step = self.rate * self._step(np.bincount(at[j], q - y, len(self.tables[j])), np.bincount(at[j], q * (1 - q), len(self.tables[j])), 2)
                self.tables[j] += step
                f += step[at[j]]
        coarse = [self._cuts(x[:, j], self.pair_bins) for j in range(m)]
        low = [np.searchsorted(c, x[:, j]) for j, c in enumerate(coarse)]
        q = _sigmoid(f)
        ranked = []
        for a, b in combinations(range(m), 2):
            wide = len(coarse[b]) + 1
            cell, cells = low[a] * wide + low[b], (len(coarse[a]) + 1) * wide
            g, h = np.bincount(cell, q - y, cells), np.bincount(cell, q * (1 - q), cells)
            ranked.append((-(g**2 / (h + self.ridge)).sum(), a, b))
        self.pairs = [[a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))] for _, a, b in sorted(ranked)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for a, b, ca, cb, table in self.pairs:
                q, shape = _sigmoid(f), table.shape
                cell = low[a] * shape[1] + low[b]
                g = np.bincount(cell, q - y, table.size).reshape(shape)
                h = np.bincount(cell, q * (1 - q), table.size).reshape(shape)
                best, step = -1.0, None
                for k in range(1, shape[0]):  # a cut along the first feature, each side cut along the second
                    sides = [self._step(g[s].sum(0), h[s].sum(0), 1) for s in (slice(0, k), slice(k, None))]
                    gain = -sum((g[s] * v - 0.0).sum() for s, v in zip((slice(0, k), slice(k, None)), sides, strict=True))
                    if gain > best:
                        best, step = gain, np.concatenate([np.tile(sides[0], (k, 1)), np.tile(sides[1], (shape[0] - k, 1))])
                if step is not None:
                    table += self.rate * step
                    f += (self.rate * step).ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            f += t[np.searchsorted(c, x[:, j])]
        for a, b, ca, cb, t in self.pairs:
            f += t[np.searchsorted(ca, x[:, a]), np.searchsorted(cb, x[:, b])]
        return _sigmoid(f)


def labelled(labels: DataFrame, label: str, doc_id_fold: int, folds: int) -> DataFrame:
    """All labelled ids outside the held-out fold; of several labels of an id the largest."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != doc_id_fold))
    return usable.groupBy("doc_id").agg(F.max(label).alias("_label"))


def sampled_labels(docs: DataFrame, labels: DataFrame, label: str, doc_id_fold: int, folds: int, most: int) -> DataFrame:
    """At most ``most`` labelled ids of documents outside the held-out fold, those of smallest hash; of several labels of an id the largest."""
    ids = labelled(labels, label, doc_id_fold, folds).join(docs.select("doc_id"), "doc_id", "left_semi")
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> PairwiseGam:
    """Fitted on the features of at most ``most`` labelled texts that aren't held out; without any, all scores are 0.5.

    An id counts once, however often it is repeated; if it has several texts, the one of least features stands for it.
    """
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled_labels(docs, labels, "quality", 2, 4, most)), "doc_id")

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "label": batch.column(2).cast(pa.float64()), "x": pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))}

    made = arrow_map(chosen.select("doc_id", "text", "_label"), run, "doc_id long, label double, x array<double>")
    rows = sorted((r.doc_id, r.label, r.x) for r in made.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).collect())  # at most ``most``
    return PairwiseGam().fit(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: PairwiseGam, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as texts without words; repeated rows are kept; an empty table gives
    no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 18 + 8 small tables

    def run(batch: pa.RecordBatch) -> dict:
        s = shared.value.score(features(batch.column(2)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= threshold).astype("i4")}

    return arrow_map(docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")
