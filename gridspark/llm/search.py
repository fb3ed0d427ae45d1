"""Exact BM25 top-k search by an inverted index with block-max pruning, per shard, merged by global statistics.

A shard is a run of texts that a task reads.  Its postings lie in blocks of texts.  Terms that many texts have are
kept as a dense matrix with the largest impact of each term and block, the others as lists.  Queries go through a
shard in batches of queries with the same common words.  Lists are summed up first; a block is skipped for a batch if,
for each query, the block's largest impacts of the query's dense terms and the largest sum from lists in it come to less
than the k-th best score known so far (the pivot test of WAND, on blocks); the blocks of best bound are scored first.
Scores of a batch are matrix products over the columns that its queries have.  Statistics (number of texts, mean length,
document frequencies) are those of all texts, so scores of different shards compare and the k best of a task, then of
all tasks, are the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.bpe import gathered
from gridspark.llm.common import arrow_map, binary_view, lean, slices, stored, words

K1, B = 1.2, 0.75
TEXTS, TOKENS = -1, -2


class Queries:
    """Query ids and their distinct terms, as places in the sorted vocabulary of all of them."""

    def __init__(self, ids: list[int], terms: list[np.ndarray]) -> None:
        self.ids = np.array(ids, np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        flat = np.concatenate([*terms, np.zeros(0, np.uint64)]).astype(np.uint64)
        self.vocabulary, at = np.unique(flat, return_inverse=True)
        self.terms = at.astype(np.int64)
        self.table = np.full(1 << max(4, (4 * len(self.vocabulary)).bit_length()), -1, np.int32)  # places by the last bits of a hash, or after those that are taken
        left = np.arange(len(self.vocabulary), dtype=np.int32)
        slot = self._slot(self.vocabulary)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            more = self.table[slot] != left
            left, slot = left[more], (slot[more] + 1) & (len(self.table) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.table) - 1)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each word hash in the vocabulary, -1 for others."""
        slot = self._slot(h)
        out = self.table[slot].astype(np.int64)
        if not len(self.vocabulary):
            return out
        left = np.flatnonzero((out >= 0) & (self.vocabulary[out] != h))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            out[left] = self.table[slot[left]]
            left = left[(out[left] >= 0) & (self.vocabulary[out[left]] != h[left])]
        return out

    def alike(self, idf: np.ndarray, common: int = 62) -> Queries:
        """The same queries in an order in which those with the same of the most common terms lie together."""
        rank = np.full(len(self.vocabulary), common)
        often = np.argsort(idf, kind="stable")[:common]
        rank[often] = np.arange(len(often))
        rank, size = rank[self.terms], np.diff(self.first)
        key = np.zeros(len(self.ids), np.int64)
        np.add.at(key, np.repeat(np.arange(len(self.ids)), size)[rank < common], np.int64(1) << (common - 1 - rank[rank < common]))
        order = np.argsort(key, kind="stable")
        out = copy(self)
        out.ids, out.terms, out.first = self.ids[order], gathered(self.terms, self.first[order], size[order]), np.concatenate([[0], np.cumsum(size[order])])
        return out


def _first_of(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


class Shard:
    """Index of some texts for the terms of some queries."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, vocabulary: int, idf: np.ndarray, mean: float, block: int = 64, dense_share: int = 32) -> None:
        n = len(ids)
        key, tf = np.unique(term * n + doc, return_counts=True)
        term, doc = key // n, key % n
        # texts with the same leading term lie together: it tells their language, and blocks get tight bounds
        most = np.full(n, -1, np.int64)
        np.maximum.at(most, doc, tf * vocabulary + (vocabulary - 1 - term))
        lead = np.where(most < 0, -1, vocabulary - 1 - most % max(vocabulary, 1))
        order = np.lexsort((ids, lengths, lead))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, lengths, doc = ids[order], lengths[order], place[doc]
        by = np.argsort(term * n + doc)
        term, doc, tf = term[by], doc[by], tf[by]
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        self.n, self.block, self.blocks = n, block, -(-n // block)
        df = np.bincount(term, minlength=vocabulary)
        self.dense_place = np.full(vocabulary, -1, np.int64)
        many = np.flatnonzero(df * dense_share >= max(n, dense_share))
        self.dense_place[many] = np.arange(len(many))
        is_dense = self.dense_place[term] >= 0
        dense = np.zeros((len(many), self.blocks * block))
        dense[self.dense_place[term[is_dense]], doc[is_dense]] = impact[is_dense]
        self.dense = dense.reshape(len(many), self.blocks, block)
        self.dense_most = self.dense.max(2)
        self.doc, self.impact, term = doc[~is_dense], impact[~is_dense], term[~is_dense]
        self.list_first = _first_of(term, vocabulary)
        self.postings = np.arange(len(self.doc))

    def best(self, q: Queries, a: int, z: int, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query, texts' places and scores of the best k of queries a to z."""
        rows = z - a
        term, query = q.terms[q.first[a] : q.first[z]], np.repeat(np.arange(rows), np.diff(q.first[a : z + 1]))
        dense = self.dense_place[term]
        columns, at = np.unique(dense[dense >= 0], return_inverse=True)
        ask = np.zeros((rows, len(columns)))
        ask[query[dense >= 0], at] = 1
        term, query = term[dense < 0], query[dense < 0]
        size = self.list_first[term + 1] - self.list_first[term]
        where = gathered(self.postings, self.list_first[term], size)
        width = self.blocks * self.block
        lists = np.bincount(np.repeat(query * width, size) + self.doc[where], self.impact[where], rows * width).reshape(rows, self.blocks, self.block)
        bound = ask @ self.dense_most[columns] + lists.max(2)
        floor = floor.copy()
        wide = min(self.blocks, max(1, -(-2 * k // self.block)) + 1)
        ahead = np.zeros((rows, self.blocks), bool)
        np.put_along_axis(ahead, np.argpartition(-bound, wide - 1, axis=1)[:, :wide], True, axis=1)
        texts, score = np.zeros(0, np.int64), np.zeros((rows, 0))
        known = np.zeros(self.blocks, bool)
        for wanted in (ahead, None):
            todo = (bound > 0) & (bound >= floor[:, None] - 1e-6) if wanted is None else wanted & (bound > 0)
            new = np.flatnonzero(todo.any(0) & ~known)  # a block is scored for the whole batch
            known[new] = True
            mine = (new[:, None] * self.block + np.arange(self.block)).ravel()
            sums = lists[:, new].reshape(rows, len(mine)) + ask @ self.dense[columns[:, None], new].reshape(len(columns), len(mine))
            texts, score = np.concatenate([texts, mine]), np.concatenate([score, sums], axis=1)
            if score.shape[1] > k:
                floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
        row, hit = np.nonzero((score >= floor[:, None] - 1e-6) & (score > 0))
        value, hit = np.round(score[row, hit], 6), texts[hit]
        by = np.lexsort((self.ids[hit], -value, row))
        hit, value, first = hit[by], value[by], _first_of(row, rows)
        for i in range(rows):
            own = slice(first[i], min(first[i] + k, first[i + 1]))
            yield a + i, hit[own], value[own]


def _statistics(docs: DataFrame, shared) -> tuple[np.ndarray, int, int]:
    """Document frequencies of the vocabulary, and how many texts and tokens there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        df, texts, tokens = np.zeros(len(q.vocabulary), np.int64), 0, 0
        for batch in batches:
            data, at = binary_view(batch.column(0))
            for a, z in slices(at):
                _, _, h, first = words(data, at[a : z + 1])
                place, row = q.places(h), np.repeat(np.arange(z - a), np.diff(first))
                pairs = np.unique(place[place >= 0] * (z - a) + row[place >= 0])
                df += np.bincount(pairs // (z - a), minlength=len(df))
                texts, tokens = texts + z - a, tokens + len(h)
        full = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([[TEXTS, TOKENS], full]), "n": np.concatenate([[texts, tokens], df[full]])})

    table = docs.select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary and two
    term, n = table["term"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(len(shared.value.vocabulary), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term == TEXTS].sum()), int(n[term == TOKENS].sum())


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = 16 << 20, shard_texts: int = 8192, most_terms: int = 2_000_000) -> DataFrame:
    """query_id, rank, doc_id, score: the k texts of highest BM25 score for each query (query_id, text).

    Query terms are the distinct words of all rows that have the query's id.  Scores are rounded to six places; ties go to the smaller id
    and texts without any of the terms aren't found, so a null or empty query, or an empty table, gives no
    rows.  Queries are broadcast in blocks of about ``most_terms`` terms, with two readings of the texts for
    each block.  A shard is full at so many bytes or texts, as scores are held for all its texts.  Rows with a null id
    are passed over, repeated rows are found one by one.
    """
    spark = docs.sparkSession

    def terms(batch: pa.RecordBatch) -> dict:
        data, at = binary_view(batch.column(1))
        out = []
        for a, z in slices(at):
            _, _, h, first = words(data, at[a : z + 1])
            out += [np.unique(h[i:j]).view(np.int64) for i, j in zip(first[:-1], first[1:], strict=True)]
        return {"query_id": batch.column(0), "terms": pa.array(out, pa.list_(pa.int64()))}

    rows = arrow_map(queries.where("query_id is not null").select("query_id", "text"), terms, "query_id long, terms array<long>")
    rows = rows.select("query_id", F.explode("terms").alias("term")).distinct()
    asked = stored(rows.groupBy("query_id").agg(F.collect_list("term").alias("terms")), "search")  # an id's distinct words
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // most_terms))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    found: DataFrame | None = None
    for number in range(blocks):
        rows = sorted((r.query_id, r.terms) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toLocalIterator())
        mine = Queries([r[0] for r in rows], [np.array(r[1], np.int64).view(np.uint64) for r in rows])
        shared = spark.sparkContext.broadcast(mine)
        df, n, tokens = _statistics(texts, shared)
        numbers = spark.sparkContext.broadcast((np.log(1 + (n - df + 0.5) / (df + 0.5)), max(tokens, 1) / max(n, 1)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, numbers=numbers) -> Iterator[pa.RecordBatch]:
            idf, mean = numbers.value
            q = shared.value.alike(idf)
            top = [(np.zeros(0, np.int64), np.zeros(0))] * len(q.ids)  # of this task's shards so far
            floor = np.zeros(len(q.ids))

            def look(part: list[tuple[np.ndarray, ...]], ids: list[np.ndarray]) -> None:
                lengths, doc, term = (np.concatenate(x) for x in zip(*part, strict=True))
                shard = Shard(np.concatenate(ids), lengths, doc, term, len(q.vocabulary), idf, mean)
                for a in range(0, len(q.ids), 128):
                    z = min(len(q.ids), a + 128)
                    for i, place, value in shard.best(q, a, z, k, floor[a:z]):
                        name, value = np.concatenate([top[i][0], shard.ids[place]]), np.concatenate([top[i][1], value])
                        by = np.lexsort((name, -value))[:k]
                        top[i] = name[by], value[by]
                        if len(by) == k:
                            floor[i] = top[i][1][-1]

            part, ids, size, count = [], [], 0, 0
            for batch in batches:
                data, at = binary_view(batch.column(1))
                name = batch.column(0).to_numpy()
                for a, z in slices(at):
                    _, _, h, first = words(data, at[a : z + 1])
                    place, row = q.places(h), np.repeat(np.arange(z - a), np.diff(first))
                    part.append((np.diff(first), row[place >= 0] + count, place[place >= 0]))
                    ids.append(name[a:z])
                    size, count = size + int(at[z] - at[a]), count + z - a
                    if size >= shard_bytes or count >= shard_texts:
                        look(part, ids)
                        part, ids, size, count = [], [], 0, 0
            if count:
                look(part, ids)
            for a in range(0, len(q.ids), 1000):
                name, value = zip(*top[a : a + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids[a : a + 1000], [len(x) for x in value])), pa.array(np.concatenate(name)), pa.array(np.concatenate(value))], ["query_id", "doc_id", "score"])

        one = texts.mapInArrow(lean(run), "query_id long, doc_id long, score double")
        found = one if found is None else found.unionAll(one)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
