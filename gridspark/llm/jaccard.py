"""Exact join of texts whose shingle sets are similar: their links, and the groups that links make.

Under any order of all shingles, two sets of Jaccard similarity t or more share one of the first
n - ceil(t * n) + 1 shingles of each (their prefixes).  Three orders are used.  All put shingles that many texts
have last; how many is estimated from a sixteenth of the texts and kept in a table of fixed size, which need not
be exact, as any order that is the same for all texts will do.

Texts with equal sets are one class; it is compared once.  The first order's prefixes make an index, which leads
classes to places where they meet: a place has hosts and guests, who are compared there in blocks.  Before any set
is sent to a place, the prefixes under all orders are, and only classes go on that share enough of each of them
with one partner.  No row is made for a pair; a set is sent once for each block of a place.

First each index entry has one class as host and the others as guests, which joins most similar classes into
families.  Then the places are families: of two families whose members share an index entry, those members of the
smaller one visit the other.  So every two similar classes meet, either as hosts of one place or as host and guest.

Texts of which many are nearly, but not quite, similar make many families that share their entries; visits between
all of them would be a row for each pair.  So families that meet many others at an entry are gathered around one of
them before, whether or not they are linked, and compared there as hosts of one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import _MUL, binary_view, dropped, forget, grams, lean, mix, sized, slices, stored, words

SHINGLE = 5
#: One text in so many (by hash) is looked at to see which shingles are frequent.
SAMPLE = 16
#: Cells of the table of frequent shingles, and shingles that are entered at most: 16 MB, whatever the input.
LEVEL_BITS, MOST_LEVELS = 24, 1 << 20
#: Bits of the filter of prefix shingles that several classes have: 16 MB, whatever the input.
FILTER_BITS = 27
ORDERS = (0x0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Classes and shingles that a block of a place has on average, at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 2_000_000
#: Families that may meet at an entry without being gathered, and rounds of gathering at most.
CROWD, ROUNDS = 16, 2


def sets(column: pa.Array, seed: int = 0) -> Iterator[tuple[np.ndarray, int, int]]:
    """Sorted distinct shingle hashes of each text, and two numbers that stand for the set."""
    data, at = binary_view(column)
    a1, a2 = np.uint64(2 * seed + 1) * _MUL[8], np.uint64(2 * seed + 1) * _MUL[9]
    for a, z in slices(at):
        _, _, h, first = words(data, at[a : z + 1])
        five = grams(h, tuple(range(SHINGLE)))
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= SHINGLE:
                s = np.unique(five[i : j - SHINGLE + 1])
            else:
                s = grams(h[i:j], tuple(range(j - i))) if j > i else h[:0]
            both = np.array([(mix(s * a1) * _MUL[10]).sum() + np.uint64(len(s)), (mix(s ^ a2) * _MUL[11]).sum()], np.uint64)
            key, check = mix(both).view(np.int64).tolist()
            yield s, key, check


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def prefix(s: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix in one of the global orders: lower levels first, then by a hash of that order; equal ranks all belong to it."""
    rank = (s if not order else mix(s ^ np.uint64(order))) >> np.uint64(6)
    rank |= levels[s >> np.uint64(64 - LEVEL_BITS)].astype(np.uint64) << np.uint64(58)
    size = prefix_size(len(s), percent)
    inside = rank <= np.partition(rank, size - 1)[size - 1]
    return s[inside][np.argsort(rank[inside], kind="stable")]


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def _levels(docs: DataFrame) -> np.ndarray:
    """log2 of how often frequent shingles occur in the sample, by cell; 0 for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            found = []
            for s, key, _ in sets(batch.column(0)):
                if key not in met:
                    met.add(key)
                    found.append(s)
            if found:
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": token.view(np.int64), "n": n})

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = stored(sample.mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1"), "jaccard")
    level = F.floor(F.log2("n")).cast("int") + 1
    least, room = 64, MOST_LEVELS
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 63
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    table = counts.where(level >= least).select("token", level.alias("level")).toArrow()  # at most MOST_LEVELS
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    np.maximum.at(out, (table["token"].to_numpy().view(np.uint64) >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), np.minimum(table["level"].to_numpy(), 63).astype(np.uint8))
    dropped(docs.sparkSession, counts)
    return out


def _classes(docs: DataFrame, percent: int, levels: Broadcast) -> tuple[DataFrame, int]:
    """doc_id, text_hash, row, key, check, n of each text, and p0, p1, p2 (prefixes) where a task meets a set for the first time; the seed of the keys.

    p0 has whole hashes in their order, the others 16 bits of each.
    """
    for seed in range(16):

        def run(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            met: set[int] = set()
            row = TaskContext.get().partitionId() << 36
            for batch in batches:
                out: dict[str, list] = {c: [] for c in ("key", "check", "n", "p0", "p1", "p2")}
                for s, key, check in sets(batch.column(1), seed):
                    out["key"].append(key)
                    out["check"].append(check)
                    out["n"].append(len(s))
                    new = len(s) > 0 and key not in met
                    met.add(key)
                    out["p0"].append(prefix(s, levels.value, ORDERS[0], percent).tobytes() if new else None)
                    for c, order in (("p1", ORDERS[1]), ("p2", ORDERS[2])):
                        out[c].append(prefix(s, levels.value, order, percent).astype(np.uint16).tobytes() if new else None)
                if out["n"]:
                    number, row = np.arange(row, row + batch.num_rows), row + batch.num_rows
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_hash": batch.column(2), "row": number} | {c: pa.array(v, pa.binary() if c[0] == "p" else pa.int64()) for c, v in out.items()})
            forget(levels)

        rows = stored(docs.select("doc_id", "text", _text_hash()).mapInArrow(lean(run), "doc_id long, text_hash long, row long, key long, check long, n long, p0 binary, p1 binary, p2 binary"), "jaccard")
        if rows.groupBy("key").agg((F.min("check") != F.max("check")).alias("clash")).where("clash").isEmpty():
            return rows, seed
        dropped(docs.sparkSession, rows)
    raise ValueError("different sets have one hash")


def _prefixes(rows: DataFrame, most: int) -> DataFrame:
    """key, n, p0, p1, p2 of each class once."""
    each = rows.where("p0 is not null").select("key", "row")
    again = each.groupBy("key").agg(F.min("row").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    extra = stored(each.join(again, "key").where("row <> _first").select("row"), "jaccard")
    return rows.where("p0 is not null").join(sized(extra, most), "row", "left_anti").select("key", "n", "p0", "p1", "p2")


def _shared(prefixes: DataFrame, shingles: int, per_bucket: int = 2_000_000) -> np.ndarray:
    """The filter's words: a bit for each cell with a prefix shingle of two classes.

    Tasks sort their shingles and send them in ranges, each twice at most for a batch; where a range meets, its
    shingles are counted.  The number of ranges follows the number of shingles.
    """
    bits = max(6, min(FILTER_BITS - 6, int(shingles / per_bucket).bit_length()))
    words_each = 1 << FILTER_BITS - 6 - bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)]))
            third = np.zeros(len(token), bool)
            third[2:] = token[2:] == token[:-2]
            token = token[~third]
            edge = np.searchsorted(token >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_pydict({"bucket": full.astype(np.int32), "tokens": pa.array([token[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            token = np.sort(np.concatenate(parts))
            cell = np.unique(token[1:][token[1:] == token[:-1]] >> np.uint64(64 - FILTER_BITS)) - np.uint64((bucket * words_each) << 6)
            out = np.zeros(words_each, np.uint64)
            np.bitwise_or.at(out, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "words": pa.array([out.tobytes()], pa.binary())})

        bucket, parts = -1, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and parts:
                    yield from counted()
                    parts = []
                bucket = b
                parts.append(np.frombuffer(blob.as_buffer(), np.uint64).copy())
        if parts:
            yield from counted()

    sent = prefixes.select("p0").mapInArrow(lean(send), "bucket int, tokens binary")
    table = sent.repartition(max(1 << bits, 64), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "bucket int, words binary")
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    for r in table.toLocalIterator():  # 2 ** FILTER_BITS bits in all
        out[r.bucket * words_each : (r.bucket + 1) * words_each] = np.frombuffer(bytes(r.words), np.uint64)
    return out


def _postings(prefixes: DataFrame, seen: Broadcast) -> DataFrame:
    """token, key, n, place of the prefix shingles that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            size = np.array([len(t) for t in token])
            place = np.concatenate([np.arange(m) for m in size])
            token = np.concatenate(token)
            cell = token >> np.uint64(64 - FILTER_BITS)
            hit = np.flatnonzero((seen.value[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1))
            row = np.repeat(np.arange(len(size)), size)[hit]
            yield pa.RecordBatch.from_pydict({"token": token[hit].view(np.int64), "key": batch.column(0).to_numpy()[row], "n": batch.column(1).to_numpy()[row].astype(np.int32), "place": place[hit].astype(np.int32)})
        forget(seen)

    return prefixes.select("key", "n", "p0").mapInArrow(lean(run), "token long, key long, n int, place int")


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """How many shingles similar sets of these sizes share at least."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct numbers share."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """How many numbers each of a shares with each of b (or of a); a set has distinct numbers."""
    if b is not None and len(a) * len(b) <= 64:
        return np.array([[_common(x, y) for y in b] for x in a], np.int64).reshape(len(a), len(b))
    both = a + (b or [])
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    token, column, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    often = n[column] > 1  # the others are shared by nobody
    row, column = row[often], (np.cumsum(n > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(both) - len(a) if b else len(a)), np.int64)
    columns = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, columns, width):
        i, j = np.searchsorted(column, [c, c + width])
        m = np.zeros((len(both), min(width, columns - c)), np.float32)  # sums of at most width ones are exact
        m[row[i:j], column[i:j] - c] = 1
        out += (m[: len(a)] @ (m[len(a) :] if b else m).T).astype(np.int64)
    if b is None:
        np.fill_diagonal(out, [len(x) for x in a])
    return out


class Guest:
    """One class at a place: its key, the rows it stands for, whether it is a host, its size and its arrays."""

    __slots__ = ("key", "copies", "host", "n", "arrays")

    def __init__(self, key: int, copies: int, host: bool, n: int, arrays: list[np.ndarray]) -> None:
        self.key, self.copies, self.host, self.n, self.arrays = key, copies, host, n, arrays


def similar(a: list[Guest], b: list[Guest] | None, percent: int) -> np.ndarray:
    """Which whole sets of a and b (or of a) are similar."""
    other = a if b is None else b
    na, nb = (np.array([g.n for g in x], np.int64) for x in (a, other))
    both = overlaps([g.arrays[0] for g in a], None if b is None else [g.arrays[0] for g in b])
    return 100 * both >= percent * (na[:, None] + nb - both)


def may_be_similar(a: list[Guest], b: list[Guest] | None, percent: int) -> np.ndarray:
    """Which of a and b share enough of their prefixes under every order.

    A common shingle that is not in both prefixes is beyond the end of the one that ends first.  Arrays have few
    bits of each shingle, of which several may be the same number: so many more may be shared.
    """
    other = a if b is None else b
    na, nb = (np.array([g.n for g in x], np.int64) for x in (a, other))
    out = 100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)
    beyond = -(-np.maximum(na[:, None], nb) * percent // 100) - 1
    need = np.maximum(1, -(-percent * (na[:, None] + nb) // (100 + percent)) - beyond)
    for k in range(len(ORDERS)):
        if out.any():
            mine, theirs = ([np.unique(g.arrays[k]) for g in x] for x in (a, other))
            alike = [np.array([len(g.arrays[k]) - len(u) for g, u in zip(x, y, strict=True)]) for x, y in ((a, mine), (other, theirs))]
            out &= overlaps(mine, None if b is None else theirs) + np.minimum(alike[0][:, None], alike[1]) >= need
    return out


def connected(link: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of rows and of columns, the least row that links connect them with, -1 without any; if one, columns are the rows again."""
    a = np.full(link.shape[0], -1)
    b = a if one else np.full(link.shape[1], -1)
    for i in np.flatnonzero(link.any(1)):
        if a[i] < 0:
            new = np.array([i])
            while len(new):
                a[new] = i
                to = np.flatnonzero(link[new].any(0) & (b < 0))
                b[to] = i
                new = to if one else np.flatnonzero(link[:, to].any(1) & (a < 0))
    return a, b


def _met(made: DataFrame, test: Callable[[list[Guest], list[Guest] | None, int], np.ndarray], kind: type, percent: int) -> DataFrame:
    """place, mutual, key, host, n, link: of all who have a partner, the rows of their partners in one pair of blocks and one that stands for all whom links connect there.

    made: place, mutual, host, blocks, key, copies, n, arrays (of numbers of that kind).  Guests are compared with hosts, hosts among themselves if mutual.
    """
    made = made.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    made = made.select("place", "mutual", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "host", "key", "copies", "n", "arrays")

    def meet(at: tuple, rows: dict[tuple[int, bool], tuple[int, Guest]], out: dict[str, list]) -> None:
        mutual = at[1]
        sides = [[g for block, g in rows.values() if block == x] for x in dict.fromkeys(at[2:])]
        a, b = sides[0], sides[-1]
        if not a or not b or not (mutual or any(not g.host for x in sides for g in x)) or not any(g.host for x in sides for g in x):
            return
        link = test(a, b if len(sides) > 1 else None, percent)
        hosts = [np.array([g.host for g in x]) for x in (a, b)]
        link = link & (hosts[0][:, None] | hosts[1])
        if not mutual:
            link &= ~(hosts[0][:, None] & hosts[1])
        if len(sides) == 1:
            np.fill_diagonal(link, False)
        for mine, x, y, first in list(zip((a, b), (link, link.T), (b, a), connected(link, len(sides) == 1), strict=True))[: len(sides)]:
            n = x @ np.array([g.copies for g in y], np.int64)
            for i in np.flatnonzero(x.any(1)):
                out["place"].append(at[0])
                out["mutual"].append(mutual)
                out["key"].append(mine[i].key)
                out["host"].append(mine[i].host)
                out["n"].append(int(n[i]))
                out["link"].append(None if a[first[i]].key == mine[i].key else a[first[i]].key)

    types = {"place": pa.int64(), "mutual": pa.bool_(), "key": pa.int64(), "host": pa.bool_(), "n": pa.int64(), "link": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, {}, {c: [] for c in types}

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({c: pa.array(out[c], t) for c, t in types.items()})
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            for *here, block, host, key, copies, n, arrays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != at:
                    if at:
                        meet(at, rows, out)
                        if len(out["key"]) > 5000:
                            yield given()
                    at, rows = here, {}
                if (key, host) not in rows:
                    rows[key, host] = block, Guest(key, copies, host, n, [np.frombuffer(x, kind) for x in arrays])
        if at:
            meet(at, rows, out)
        if out["key"]:
            yield given()

    dealt = made.repartition("place", "low", "high").sortWithinPartitions("place", "low", "high")
    return stored(dealt.mapInArrow(lean(run), "place long, mutual boolean, key long, host boolean, n long, link long"), "jaccard")


def _ends(members: DataFrame, reps: DataFrame) -> DataFrame:
    """members (place, mutual, key, host) with rep, copies and the number of blocks of the place, for places with a host and someone else."""
    each = members.join(reps, "key")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("size") / BLOCK_SHINGLES)).cast("long")
    many = each.groupBy("place").agg(blocks.alias("blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return stored(each.join(many, "place").select("place", "mutual", "key", "host", "rep", "copies", "blocks"), "jaccard")


def _by_prefixes(members: DataFrame, prefixes: DataFrame, reps: DataFrame, percent: int, most: int) -> DataFrame:
    """place, mutual, key, host of those members whose prefixes under all orders allow a link with someone they are compared with."""
    ends = _ends(members, reps)
    made = prefixes.join(sized(ends.withColumnRenamed("key", "_key").drop("rep"), most), F.col("key") == F.col("_key")).select("place", "mutual", "host", "blocks", "key", "copies", "n", "p0", "p1", "p2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p0 = [np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint16).tobytes() for x in batch.column(7)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array([[x, y.as_py(), z.as_py()] for x, y, z in zip(p0, batch.column(8), batch.column(9), strict=True)], pa.list_(pa.binary()))], names=[*batch.schema.names[:7], "arrays"])

    found = _met(made.mapInArrow(lean(run), "place long, mutual boolean, host boolean, blocks long, key long, copies long, n long, arrays array<binary>"), may_be_similar, np.uint16, percent)
    dropped(made.sparkSession, ends)
    return found.select("place", "mutual", "key", "host").distinct()


def _by_sets(members: DataFrame, docs: DataFrame, reps: DataFrame, seed: int, percent: int, most: int) -> DataFrame:
    """What _met() gives of the members' whole sets, which are made from their texts; ends of at most ``most`` rows are broadcast to them."""
    ends = _ends(members, reps)
    texts = docs.select("doc_id", "text").join(sized(ends, most), F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(5).to_numpy()
            texts = batch.column(0)  # of one id's texts, each is looked at by itself
            same = pc.fill_null(pc.equal(texts[1:], texts[:-1]), False).to_numpy(zero_copy_only=False).astype(bool)
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | ~same])
            found = list(sets(texts.take(pa.array(np.flatnonzero(fresh))), seed))
            of = np.cumsum(fresh) - 1
            good = [i for i, j in enumerate(of) if found[j][1] == keys[i]]  # a row of another text may have the same id
            mine = batch.take(pa.array(good, pa.int64()))
            blob = {j: [found[j][0].tobytes()] for j in {of[i] for i in good}}
            yield pa.RecordBatch.from_arrays([*mine.columns[1:], pa.array([len(found[of[i]][0]) for i in good], pa.int64()), pa.array([blob[of[i]] for i in good], pa.list_(pa.binary()))], names=[*mine.schema.names[1:], "n", "arrays"])

    made = texts.select("text", "place", "mutual", "host", "blocks", "key", "copies").mapInArrow(lean(run), "place long, mutual boolean, host boolean, blocks long, key long, copies long, n long, arrays array<binary>")
    found = _met(made, similar, np.uint64, percent)
    dropped(docs.sparkSession, ends)
    return found


def components(links: DataFrame) -> DataFrame:
    """key and root (the least key that it is connected with) of every end of a link x, y.

    Alternates large-star and small-star steps, in which every node hands its least neighbour to the
    larger and to the smaller ones; each round is written to the shared folder.
    """
    edges = stored(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "components")
    mark: tuple = ()
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        small = stored(small, "components")
        now = tuple(small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        dropped(edges.sparkSession, edges, large)
        if now == mark:
            return small.select(F.col("u").alias("key"), F.col("v").alias("root")).union(small.select("v", "v")).distinct()
        edges, mark = small, now


def join(docs: DataFrame, percent: int = 75, stars: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links of every row.

    component_id is the smallest id that links lead to, class_id the smallest one of an equal set, n_links how many
    other rows are similar, those of the row's own class included.  A text of fewer than five words has one shingle,
    all its words; one without words (or null) has none, is linked with nothing and has its own id as class and
    component.  Rows with one id and different texts are separate; a null id is passed over when the smallest is
    taken; repeated rows are linked with each other; an empty table gives no rows; other columns are not read.
    """
    return _join(docs, percent, stars, True).drop("key", "text_hash", "root")


def one_of_each(docs: DataFrame, percent: int = 75, stars: int = 2) -> DataFrame:
    """One row, with all its columns, of each group: one of its smallest id, of several texts that of least hash.

    Texts without words all stay.
    """
    rows = stored(_join(docs, percent, stars, False), "jaccard")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rows.where("n_shingles > 0").groupBy("root").agg(F.min(key).alias("k")).select("k.doc_id", "k.text_hash")
    # a row that occurs once needs no look at the others; repeated ones are few or alike
    kept = rows.where("n_shingles > 0").groupBy("doc_id", "text_hash").agg((F.count("*") > 1).alias("_again")).withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    kept = kept.join(first, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))).select("_d", "_t", "_again")
    bare = rows.where("n_shingles = 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.lit(False).alias("_again")).distinct()
    kept = stored(kept.union(bare), "jaccard")
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", _text_hash())  # no name of docs can clash with another
    out = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")))
    return out.where("not _again").select("_row.*").union(out.where("_again").dropDuplicates(["doc_id", "text_hash"]).select("_row.*"))


def _mixed(index: DataFrame, turn: int) -> DataFrame:
    """The entries whose members are in different families, with one of the members; the others have nothing more to say."""
    one = F.min_by(F.struct("key", "n", "place", "root"), F.xxhash64("root", "key", F.lit(turn))).alias("one")
    mixed = index.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), one).where("_low <> _high").select("token", "one")
    return stored(index.join(mixed, "token"), "jaccard")


def _stars(index: DataFrame, percent: int) -> DataFrame:
    """place, mutual, key, host: of each entry one class as host, and each class as guest of the one it has most in common with."""
    na, nb = F.col("n").cast("long"), F.col("one.n").cast("long")
    fits = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - F.col("place"), nb - F.col("one.place")) >= _needed(na, nb, percent))
    met = index.where((F.col("root") != F.col("one.root")) & fits).select("key", F.col("one.key").alias("at"))
    most = met.groupBy("key", "at").agg(F.count("*").alias("shared")).groupBy("key").agg(F.max_by("at", F.struct("shared", "at")).alias("place"))
    most = stored(most.select("place", "key"), "jaccard")
    never = F.lit(False).alias("mutual")
    return most.select("place", never, "key", F.lit(False).alias("host")).union(most.select("place", never, F.col("place").alias("key"), F.lit(True)).distinct())


def _moves(index: DataFrame, percent: int) -> DataFrame:
    """root, leader: families at entries where many meet, and the family of the entries' classes with which theirs have most in common.

    A class counts if it shares half of what visitors must share at least; leaders stay where they are.
    """
    crowds = index.select("token", "root").distinct().groupBy("token").count().where(F.col("count") > CROWD).select("token")
    na, nb = F.col("n").cast("long"), F.col("one.n").cast("long")
    met = index.join(crowds, "token").where((F.col("root") != F.col("one.root")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb)))
    need = _needed(na, nb, percent) - F.ceil(F.greatest(na, nb) * percent / 100) + 1
    each = met.groupBy("root", "key", F.col("one.root").alias("leader"), F.col("one.key").alias("at")).agg(F.count("*").alias("shared"), F.first(need).alias("need")).where(2 * F.col("shared") >= F.col("need"))
    best = each.groupBy("root", "leader").agg(F.sum("shared").alias("shared")).groupBy("root").agg(F.max_by("leader", F.struct("shared", "leader")).alias("leader"))
    best = stored(best, "jaccard")
    # of two that lead each other the smaller root stays
    leaders = best.join(best.select(F.col("root").alias("leader"), F.col("leader").alias("_of")), "leader", "left").where("_of is null or _of <> root or leader < root").select(F.col("leader").alias("root")).distinct()
    return stored(best.join(leaders, "root", "left_anti"), "jaccard")


def _gathered(families: DataFrame, moves: DataFrame) -> DataFrame:
    """key, root, family (its size) when the roots of moves, which may be single classes, have gone over to their leaders."""
    alone = moves.select("root").union(moves.select("leader")).distinct().join(families.select(F.col("key").alias("root")), "root", "left_anti")
    each = families.select("key", "root").union(alone.select(F.col("root").alias("key"), "root")).join(moves, "root", "left").select("key", F.coalesce("leader", "root").alias("root"))
    return stored(each.join(each.groupBy("root").agg(F.count("*").alias("family")), "root").select("key", "root", "family"), "jaccard")


def _visits(index: DataFrame, percent: int) -> DataFrame:
    """place (a family's root) and key of every class of another, smaller family that may be similar to one of its members by the entries that they share.

    Two classes of different families share no other entries than these, so what they share of their prefixes is
    counted here; the least that they must share grows and then falls with the other's size.
    """
    family = index.groupBy("token", F.col("root").alias("at"), F.col("family").alias("size")).agg(F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"), F.max(F.col("n") - F.col("place")).cast("long").alias("left"))
    n = F.col("n").cast("long")
    low, high = F.greatest(F.col("least"), F.ceil(n * percent / 100)), F.least(F.col("most"), F.floor(n * 100 / percent))
    smaller = (F.col("family") < F.col("size")) | (F.col("family") == F.col("size")) & (F.col("root") < F.col("at"))
    met = index.select("token", "key", "n", "place", "root", "family").join(family, "token").where(smaller & (low <= high))
    begin = F.least(n - F.col("place"), F.col("left")) >= _needed(n, low, percent)
    each = met.groupBy(F.col("at").alias("place"), "key").agg(F.count("*").alias("shared"), F.max(begin).alias("begin"), F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    need = F.least(*(_needed(n, x, percent) - F.ceil(F.greatest(n, x) * percent / 100) + 1 for x in (low, high)))
    return each.where(F.col("begin") & (F.col("shared") >= need)).select("place", "key")


def _join(docs: DataFrame, percent: int, stars: int, count: bool, most: int = 2_000_000) -> DataFrame:
    spark = docs.sparkSession
    rows, seed = _classes(docs, percent, spark.sparkContext.broadcast(_levels(docs)))
    prefixes = _prefixes(rows, most)
    mine = rows.where("n > 0").select("doc_id", "key", "n")
    reps = stored(mine.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("size")), "jaccard")
    shingles = prefixes.agg(F.coalesce(F.sum(F.octet_length("p0") / 8), F.lit(0))).first()[0]
    seen = spark.sparkContext.broadcast(_shared(prefixes, shingles))
    old = stored(_postings(prefixes, seen), "jaccard")
    seen.unpersist()
    index = _mixed(old.withColumns({"root": F.col("key"), "family": F.lit(1).cast("long")}), 0)
    dropped(spark, old)
    links = spark.createDataFrame([], "x long, y long")
    groups, families = spark.createDataFrame([], "key long, root long"), spark.createDataFrame([], "key long, root long, family long")

    def named_anew(index: DataFrame, turn: int) -> DataFrame:
        new = index.select("token", "key", "n", "place").join(sized(families, most), "key", "left")
        new = _mixed(new.withColumns({"root": F.coalesce("root", "key"), "family": F.coalesce("family", F.lit(1))}), turn)
        dropped(spark, index)
        return new

    for turn in range(1, stars + 1):
        likely = _by_prefixes(_stars(index, percent), prefixes, reps, percent, most)
        found = _by_sets(likely, docs, reps, seed, percent, most)
        links = links.union(found.where("link is not null").select(F.col("key").alias("x"), F.col("link").alias("y")))
        groups = components(links)
        families = stored(groups.join(groups.groupBy("root").agg(F.count("*").alias("family")), "root").select("key", "root", "family"), "jaccard")
        index = named_anew(index, turn)
    for turn in range(stars + 1, stars + 1 + ROUNDS):
        moves = _moves(index, percent)
        if moves.isEmpty():
            break
        families = _gathered(families, moves)
        index = named_anew(index, turn)
    visits = stored(_visits(index, percent), "jaccard")
    dropped(spark, index)
    # places of families that aren't linked throughout: their hosts have to be compared among themselves
    of = families.join(groups.select("key", F.col("root").alias("_linked")), "key", "left").withColumn("_linked", F.coalesce("_linked", "key"))
    loose = of.groupBy(F.col("root").alias("place")).agg((F.min("_linked") != F.max("_linked")).alias("mutual")).where("mutual")
    places = stored(visits.select("place").distinct().join(loose, "place", "full").select("place", F.coalesce("mutual", F.lit(False)).alias("mutual")), "jaccard")
    hosts = families.select(F.col("root").alias("place"), "key").union(reps.join(families, "key", "left_anti").select(F.col("key").alias("place"), "key"))
    members = visits.select("place", "key", F.lit(False).alias("host")).union(hosts.join(places.select("place"), "place").select("place", "key", F.lit(True).alias("host")))
    likely = _by_prefixes(members.join(places, "place").select("place", "mutual", "key", "host"), prefixes, reps, percent, most)
    if count:
        inside = of.join(groups.select("key"), "key").select(F.col("root").alias("place"), F.lit(True).alias("mutual"), "key", F.lit(True).alias("host"))
        likely = likely.withColumn("mutual", F.lit(True)).union(inside).distinct()
    found = _by_sets(likely, docs, reps, seed, percent, most)
    last = found.where("link is not null").select(F.col("key").alias("x"), F.col("link").alias("y"))
    if not last.isEmpty():
        groups = components(links.union(last))
    least = groups.join(reps, "key").groupBy("root").agg(F.min("rep").alias("least"))
    named = reps.join(groups.join(least, "root"), "key", "left").select("key", F.col("rep").alias("class_id"), F.coalesce("least", "rep").alias("component_id"), F.coalesce("root", "key").alias("root"), "copies")
    columns = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), "key", "text_hash", "root"]
    if count:
        named = named.join(found.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.select("doc_id", "key", "text_hash", F.col("n").alias("n_shingles")).join(named, "key", "left")
    return out.select(*columns)
