"""Log probability of texts by prediction by partial matching over bytes, with a word unigram base.

Texts are lower-cased (A-Z).  The byte 0xFF, which UTF-8 has not, stands before a text and ends it, so a
text's probability includes its end.  The trie of contexts of up to ``order`` bytes is kept as sorted
arrays, one per order; escape probabilities are by method D (a symbol met n times weighs 2n - 1, leaving weighs 1 for each distinct symbol), and a
symbol that a longer context has seen is excluded from the shorter ones.  Trained and then fixed, the model
makes everything that is needed at a position a function of its context and symbol, so scoring is lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, binary_view, fold, lean, LOWER, slices, stored, words

EDGE = 0xFF
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def codes(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte of the rows and of their ends: the ``order`` bytes before and itself as one number; starts of rows."""
    rows = len(at) - 1
    place = at - at[0] + np.arange(rows + 1) * (order + 1) + order  # of each row's first byte
    stream = np.full(int(at[-1] - at[0]) + rows * (order + 1) + order, EDGE, np.uint8)
    keep = np.ones(len(stream), bool)
    keep[:order] = False
    for k in range(order):
        keep[place[1:] - order + k] = False
    body = keep.copy()
    body[place[1:] - order - 1] = False
    stream[body] = LOWER[data[at[0] : at[-1]]]
    code = np.zeros(len(stream) - order, np.uint64)
    for k in range(order + 1):
        code <<= np.uint64(8)
        code |= stream[k : len(stream) - order + k]
    return code[keep[order:]], at - at[0] + np.arange(rows + 1)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], np.add.reduceat(counts, edge)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Ppm:
    """Tables of a trie.  grams: distinct codes of order+1 bytes, with their counts.

    A trie can be cut by the last bytes before the symbol: then grams has those of some of them, and shorter
    the codes and counts of the orders from 1 on that the cut leaves incomplete, with all symbols after any
    context that ends the ones here (order 0 is made from order 1).

    For a context c whose shorter one is p: top(c) is the log weight of leaving c when nothing is excluded
    and then all shorter contexts down to none, down(c) what turns a symbol's count in p into its log
    weight after c has been left.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, shorter: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        if not 2 <= order <= 6:
            raise ValueError("the order must be 2 to 6")
        self.order = order
        by = np.argsort(grams)
        key, n = grams[by].astype(np.uint64), counts[by].astype(np.float64)
        levels = [None] * (order + 1)
        for k in range(order, -1, -1):
            if k < order:
                key = key & np.uint64((1 << 8 * (k + 1)) - 1)
                by = np.argsort(key, kind="stable")
                key, n = _sums(key[by], n[by])
            if shorter and k in shorter:
                by = np.argsort(shorter[k][0])
                key, n = shorter[k][0][by].astype(np.uint64), shorter[k][1][by].astype(np.float64)
            levels[k] = (key, n)
        levels = [(key, 2 * n - 1) for key, n in levels]
        self.contexts: list[np.ndarray] = []
        self.top: list[np.ndarray] = []
        self.down: list[np.ndarray] = []
        self.gram_keys, self.gram_logs = [x for x, _ in levels], [np.log(y).astype(np.float32) for _, y in levels]
        below = np.zeros(1)  # sum of the logs of escapes under a context's shorter ones
        for k, (key, n) in enumerate(levels):
            context = key >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.zeros(0, np.int64)
            names, total, kinds = context[first], np.add.reduceat(n, first) if len(key) else n, np.diff(np.append(first, len(key)))
            if k == 0:
                left = np.full(len(names), 256.0) - kinds
                down, leave = -np.log(np.maximum(left, 1)), np.zeros(len(names))
            else:
                pk, pn = levels[k - 1]
                at, _ = _find(pk, key & np.uint64((1 << 8 * k) - 1))  # the same symbol after the shorter context
                shorter, _ = _find(self.contexts[k - 1], names & np.uint64((1 << 8 * (k - 1)) - 1))
                seen = np.add.reduceat(pn[at], first) if len(key) else n
                rest, kinds_left = self._total[shorter] - seen, self._kinds[shorter] - kinds
                down = -np.log(np.maximum(rest + kinds_left, 1))
                leave = np.where(kinds_left > 0, np.log(np.maximum(kinds_left, 1)) + down, 0.0) + below[shorter]
            self.contexts.append(names)
            self.top.append((np.log(kinds / (total + kinds)) + leave).astype(np.float32))
            self.down.append((down - leave).astype(np.float32))
            self._total, self._kinds, below = total, kinds, leave
            if k == order:
                self.full = (self.gram_logs[k] - np.log(total + kinds)[np.searchsorted(first, np.arange(len(key)), "right") - 1]).astype(np.float32)
            self.start = getattr(self, "start", []) + [(-np.log(total + kinds)).astype(np.float32)]
        del self._total, self._kinds

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Open addressing with linear probing over the longest grams; made by each worker when it first scores."""
        if not hasattr(self, "_hash"):
            keys = self.gram_keys[self.order]
            bits = max(4, int(len(keys) * 2).bit_length())
            slot_key, slot = np.full(1 << bits, ~np.uint64(0), np.uint64), np.zeros(1 << bits, np.float32)
            shift, left = np.uint64(64 - bits), np.arange(len(keys))
            at = ((keys * _MULTIPLIER) >> shift).astype(np.int64)
            while len(left):
                free = slot_key[at[left]] == ~np.uint64(0)
                one = left[free][np.unique(at[left[free]], return_index=True)[1]]
                slot_key[at[one]], slot[at[one]] = keys[one], self.full[one]
                left = left[slot_key[at[left]] != keys[left]]
                at[left] = (at[left] + 1) & ((1 << bits) - 1)
            self._hash = slot_key, slot, shift
        return self._hash

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_hash"}

    def logs(self, code: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the last byte of each code after the others."""
        slot_key, slot, shift = self._table()
        at = ((code * _MULTIPLIER) >> shift).astype(np.int64)
        found = slot_key[at]
        out = slot[at].astype(np.float64)
        odd = np.flatnonzero(found != code)
        left, mask = odd[found[odd] != ~np.uint64(0)], len(slot) - 1
        missing = [odd[found[odd] == ~np.uint64(0)]]
        while len(left):
            at[left] = (at[left] + 1) & mask
            found = slot_key[at[left]]
            hit = found == code[left]
            out[left[hit]] = slot[at[left[hit]]]
            missing.append(left[found == ~np.uint64(0)])
            left = left[~hit & (found != ~np.uint64(0))]
        odd = np.concatenate(missing)
        if len(odd):
            unlike, back = np.unique(code[odd], return_inverse=True)
            out[odd] = self._descend(unlike)[back]
        return out

    def _descend(self, code: np.ndarray) -> np.ndarray:
        """The same for codes that the longest contexts haven't seen."""
        out, weight = np.zeros(len(code)), np.zeros(len(code))
        begun, done = np.zeros(len(code), bool), np.zeros(len(code), bool)
        down = np.zeros(len(code))
        for k in range(self.order, -1, -1):
            gram = code & np.uint64((1 << 8 * (k + 1)) - 1)
            at, has = _find(self.gram_keys[k], gram)
            place, seen = _find(self.contexts[k], gram >> np.uint64(8))
            now = has & ~done
            if now.any():
                fresh = now & ~begun  # the longest known context has the symbol
                out[fresh] = self.gram_logs[k][at[fresh]] + self.start[k][place[fresh]]
                later = now & begun
                out[later] = weight[later] + down[later] + self.gram_logs[k][at[later]]
                done |= now
            go = seen & ~done
            fresh = go & ~begun
            weight[fresh] = self.top[k][place[fresh]]
            begun |= fresh
            down[go] = self.down[k][place[go]]
        rest = ~done
        out[rest] = np.where(begun[rest], weight[rest] + down[rest], -np.log(256.0))
        return out


class _Tally:
    """Sums by key of what a task has met; given out in parts, so that it stays small."""

    def __init__(self, kind: int, most: int = 1_500_000) -> None:
        self.kind, self.most, self.keys, self.counts, self.size = kind, most, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2 * self.most:
            self._merge()
            if self.size > self.most:
                yield from self.rest()

    def _merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        by = np.argsort(keys)
        keys, counts = _sums(keys[by], counts[by])
        self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self._merge()
            keys, counts = self.keys[0].view(np.int64), self.counts[0].astype(np.int64)
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_pydict({"kind": np.full(len(k), self.kind, np.int32), "key": k, "n": counts[a : a + 100_000]})
            self.keys, self.counts, self.size = [], [], 0


GRAM, WORD, END = 0, 1, 0


def counted(docs: DataFrame, order: int) -> DataFrame:
    """kind, key, n: how often each gram of order+1 bytes and each word (by its 64-bit hash; 0 is the end) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, heads = _Tally(GRAM), _Tally(WORD)
        for batch in batches:
            data, at = binary_view(batch.column(0))
            for a, z in slices(at):
                yield from grams.add(*np.unique(codes(data, at[a : z + 1], order)[0], return_counts=True))
                h = words(data, at[a : z + 1])[2]
                h[h == END] = 1
                yield from heads.add(*np.unique(np.concatenate([h, np.full(z - a, END, np.uint64)]), return_counts=True))
        yield from grams.rest()
        yield from heads.rest()

    return docs.select("text").mapInArrow(lean(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table[c].to_numpy() for c in names]


class _Cover:
    """The codes that a block answers: those whose last ``depth`` bytes before the symbol are among names and, if
    rest = (n, ending, known) is given, those whose last n are the ending and whose last depth are not known."""

    def __init__(self, depth: int, names: np.ndarray, rest: tuple[int, int, np.ndarray] | None) -> None:
        self.depth, self.names, self.rest = depth, names, rest

    def __call__(self, code: np.ndarray) -> np.ndarray:
        last = (code >> np.uint64(8)) & np.uint64((1 << 8 * self.depth) - 1)
        mine = _find(self.names, last)[1]
        if self.rest is not None:
            n, ending, known = self.rest
            mine |= ((last & np.uint64((1 << 8 * n) - 1)) == np.uint64(ending)) & ~_find(known, last)[1]
        return mine


def _blocks(grams: DataFrame, order: int, most: int) -> Iterator[tuple[Ppm, _Cover | None]]:
    """The trie in blocks of at most ``most`` grams (256 if that is more), each with the codes that it answers, or None for all.

    A block has the grams of some endings of contexts.  Endings have two bytes at first; one of more than
    ``most`` grams is cut into those one byte longer, up to whole contexts, which have at most 256 grams.
    """

    def ending(depth: int) -> Column:
        return F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * depth) - 1)

    def level(k: int, frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys, n = _arrays(frame.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("k")).agg(F.sum("n").alias("n")), "k", "n")
        return keys.view(np.uint64), n

    def cut(depth: int, frame: DataFrame, shorter: dict[int, tuple[np.ndarray, np.ndarray]], under: tuple[int, int]) -> Iterator[tuple[Ppm, _Cover | None]]:
        names, n = _arrays(frame.groupBy(ending(depth).alias("e")).agg(F.count("*").alias("n")), "e", "n")  # at most 65,536, or 256 of a longer ending
        by = np.argsort(names)
        names, n = names[by].view(np.uint64), n[by]
        hot = (n > most) & (depth < order)
        parts: list[list[int]] = [[]]
        size = 0
        for i in np.flatnonzero(~hot):
            if size and size + n[i] > most:
                parts.append([])
                size = 0
            parts[-1].append(i)
            size += n[i]
        for part in parts:
            mine = names[part] if part else names[:0]
            whole = len(mine) == len(names)
            wanted = frame.sparkSession.createDataFrame([(int(x),) for x in mine], "e long")
            keys, counts = _arrays(frame if whole else frame.join(F.broadcast(wanted), ending(depth) == F.col("e"), "left_semi"), "key", "n")
            covers = None if whole and depth == 2 else _Cover(depth, mine, (*under, names) if part is parts[0] else None)
            yield Ppm(keys.view(np.uint64), counts, order, shorter), covers
        for e in names[hot]:
            own = frame.where(ending(depth) == int(e))
            yield from cut(depth + 1, own, shorter | {depth: level(depth, own)}, (depth, int(e)))

    yield from cut(2, grams, {1: level(1, grams)}, (0, 0))  # at most 65,536 pairs of a byte and its symbol


def _scores(model: Ppm, covers: _Cover | None, data: np.ndarray, own: np.ndarray) -> np.ndarray:
    code, start = codes(data, own, model.order)
    if covers is None:
        logs = model.logs(code)
    else:
        logs, mine = np.zeros(len(code)), covers(code)
        logs[mine] = model.logs(code[mine])
    return np.add.reduceat(logs, start[:-1]) / np.log(10)


def score(docs: DataFrame, order: int = 5, heavy_share: int = 1 << 22, most_grams: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose fold (of 7) is not 2.  base_score: add-one unigrams of words and an end.
    Words with at least 1 / heavy_share of all training tokens (at most heavy_share of them) are looked up
    where the text is read, the others in a join.  A trie of more than ``most_grams`` grams is used in
    blocks, with one reading of the texts for each.  Null texts are empty ones, whose end alone is scored;
    repeated rows are kept; an empty table gives no rows; without training rows every byte has 1/256.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    counts = stored(counted(rows.where("not held_out"), order), "ppm")
    grams, heads = counts.where(f"kind = {GRAM}"), counts.where(f"kind = {WORD}")
    total, kinds = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    least = max(1, -(-total // heavy_share))
    keys, n = _arrays(heads.where((F.col("n") >= least) | (F.col("key") == END)), "key", "n")
    by = np.argsort(keys.view(np.uint64))
    heavy = spark.sparkContext.broadcast((keys.view(np.uint64)[by], np.log10(n[by] + 1.0)))
    below = float(np.log10(total + kinds + 1))

    blocks = _blocks(grams, order, most_grams)
    first = spark.sparkContext.broadcast(next(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, (known, logs), (model, covers) = TaskContext.get().partitionId() << 36, heavy.value, first.value
        for batch in batches:
            data, at = binary_view(batch.column(2))
            out = {k: [] for k in ("n_tokens", "n_known", "base", "score", "rare")}
            for a, z in slices(at):
                own = at[a : z + 1]
                _, _, h, begin = words(data, own)
                h[h == END] = 1
                of = np.repeat(np.arange(z - a), np.diff(begin))
                unlike, back = np.unique(h, return_inverse=True)
                place, has = _find(known, unlike)
                value = np.where(has, logs[place], 0.0) if len(known) else np.zeros(len(unlike))
                has, value = has[back], value[back]
                end_place, end_has = _find(known, np.zeros(1, np.uint64))
                end = float(logs[end_place[0]]) if end_has[0] else 0.0
                out["n_tokens"].append(np.diff(begin) + 1)
                out["n_known"].append(np.bincount(of, has, z - a).astype(np.int64) + int(end_has[0]))
                out["base"].append(np.bincount(of, value, z - a) + end - below * (np.diff(begin) + 1))
                out["score"].append(_scores(model, covers, data, own))
                rare, count = h[~has].view(np.int64), np.bincount(of[~has], minlength=z - a)
                out["rare"].append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(rare)))
            size = batch.num_rows
            done = {k: np.concatenate(v) for k, v in out.items() if k != "rare"}
            rare = pa.concat_arrays(out["rare"])
            yield pa.RecordBatch.from_pydict({"row": np.arange(base, base + size), "doc_id": batch.column(0), "held_out": batch.column(1), "text_hash": batch.column(3)} | done | {"rare": rare})
            base += size

    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    schema = "row long, doc_id long, held_out boolean, text_hash long, n_tokens long, n_known long, base double, score double, rare array<long>"
    main = stored(rows.select("*", text_hash).mapInArrow(lean(run), schema), "ppm")
    each = main.select("row", F.explode("rare").alias("key")).join(heads.where(F.col("n") < least).select("key", "n"), "key", "left")
    rare = each.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("_more"), F.count("n").alias("_known")) if total and least > 1 else None
    out = main.drop("rare")
    for block in blocks:
        one = spark.sparkContext.broadcast(block)

        def part(batch: pa.RecordBatch, one=one) -> dict:
            (model, covers), (data, at) = one.value, binary_view(batch.column(2))
            return {"doc_id": batch.column(0), "text_hash": batch.column(1), "part": np.concatenate([_scores(model, covers, data, at[a : z + 1]) for a, z in slices(at)])}

        more = arrow_map(docs.select("doc_id", text_hash, "text"), part, "doc_id long, text_hash long, part double").groupBy("doc_id", "text_hash").agg(F.first("part").alias("part")).withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
        out = out.join(more, out.doc_id.eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))).withColumn("score", F.col("score") + F.col("part")).drop("_d", "_t", "part")
    if rare is not None:
        out = out.join(rare, "row", "left")
    else:
        out = out.withColumns({"_more": F.lit(0.0), "_known": F.lit(0)})
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score")
