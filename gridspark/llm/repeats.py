"""Runs of words that repeat with a period, found in whole texts and collapsed to their first period.

A run is a stretch of words that no neighbour extends, of smallest period q, at least ``times`` periods and ``least``
words long.  Moved by q it overlaps with itself in k words at least, where k follows from those two numbers, so each
of its words is in a k-gram that the text has twice.  All other words are masked, and only what is left between them
is searched, by Main and Lorentz' halving: the runs through the middle of a piece are those where two places q apart
agree far enough to the left and right.  How far is looked up in names of all stretches of 1, 2, 4, ... words, which
are equal exactly if the stretches are.  Pieces of all texts of a slice are halved together.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE, arrow_map, binary_view, grams, mix, slices

SPAN = "struct<start: long, length: long, period: long>"


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows whose bytes are data[at[0]] to data[at[-1]]: bytes of all words, their offsets, numbers that are equal for equal words, first word of each row."""
    b = data[at[0] : at[-1]]
    solid = np.append(~SPACE[b], False)
    edge = np.zeros(len(solid), bool)
    edge[at - at[0]] = True
    start = np.flatnonzero(solid & (edge | ~np.append(False, solid[:-1])))
    stop = np.flatnonzero(solid[:-1] & (edge[1:] | ~solid[1:])) + 1
    letters, offsets = b[solid[:-1]], np.append(0, np.cumsum(stop - start)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return letters, offsets, ids, np.searchsorted(start, at - at[0])


def overlap(least: int, times: int) -> int:
    """The fewest words that a run has in common with itself when it is moved by its period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def survivors(ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Words in a k-gram that their row has more than once; grams of one hash only let more words through."""
    out = np.zeros(len(ids) + 1, np.int64)
    n = len(ids) - k + 1
    if n > 0:
        whole = np.flatnonzero(row[:n] == row[k - 1 :])
        key = mix(grams(mix(ids.astype(np.uint64) + np.uint64(1)), tuple(range(k)))[whole] + row[whole].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = whole[order[np.append(same, False) | np.append(False, same)]] if len(whole) else whole
        np.add.at(out, again, 1)
        np.add.at(out, again + k, -1)
    return out[:-1].cumsum() > 0


class Names:
    """Numbers of all stretches of 2^j words; two stretches agree for as long as their numbers are equal."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.levels = [np.unique(values, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.levels) - 1) <= longest:
            last, half = self.levels[-1].astype(np.int64), 1 << (len(self.levels) - 1)
            self.levels.append(np.unique(last[:-half] * len(values) + last[half:], return_inverse=True)[1].astype(np.int32))

    def ahead(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many words from i and from k (behind i) on are equal."""
        n = np.zeros(len(i), np.int64)
        for j in reversed(range(len(self.levels))):
            level = self.levels[j]
            x, y = i + n, k + n
            inside = np.flatnonzero(y < len(level))
            n[inside] += (level[x[inside]] == level[y[inside]]).astype(np.int64) << j
        return n

    def before(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many words before i and before k (behind i) are equal."""
        n = np.zeros(len(i), np.int64)
        for j in reversed(range(len(self.levels))):
            level = self.levels[j]
            x, y = i - n - (1 << j), k - n - (1 << j)
            inside = np.flatnonzero(x >= 0)
            n[inside] += (level[x[inside]] == level[y[inside]]).astype(np.int64) << j
        return n


def runs_of(values: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs in the pieces low to high of values, sorted by start and period; a value of its own follows each piece."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    names = Names(values, int((high - low).max())) if len(low) else None
    while names:
        large = high - low >= least
        if not large.any():
            break
        low, high = low[large], high[large]
        middle, most = (low + high) // 2, (high - low) // times
        at = np.repeat(middle, most)
        q = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
        for i, k in ((at, at + q), (at - q, at)):
            start, stop = i - names.before(i, k), k + names.ahead(i, k)
            good = stop - start >= np.maximum(least, times * q)
            found.append((start[good], stop[good], q[good]))
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
    start, stop, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(start)]  # multiples of a period come after it
    start, stop, q = start[smallest], stop[smallest], q[smallest]
    order = np.lexsort((q, start))
    return start[order], stop[order], q[order]


def runs_in(ids: np.ndarray, row: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of words within rows."""
    kept = survivors(ids, row, overlap(least, times))
    begins = kept & (np.append(True, ~kept[:-1]) | np.append(True, row[1:] != row[:-1]))[: len(kept)]
    ends = kept & (np.append(~kept[1:], True) | np.append(row[1:] != row[:-1], True))[: len(kept)]
    low, high = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = high - low >= least
    low, size = low[long], (high - low)[long]
    first = np.cumsum(size + 1) - size - 1
    place = np.arange(int((size + 1).sum())) - np.repeat(first, size + 1) + np.repeat(low, size + 1)  # of each value, that behind a piece included
    values = ids[np.minimum(place, len(ids) - 1)] if len(ids) else ids
    values[first + size] = len(ids) + np.arange(len(size))
    start, stop, q = runs_of(values, first, first + size, least, times)
    return place[start], place[stop], q


def find(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs, best, collapsed of every row.

    runs: start, length and period in words, by start and period; best: the one of greatest length / period, of equal
    ones that of smallest start, then period, null without any.  collapsed: the words joined by one space, without
    those that any run has after its first period.  A null text has no words; a text without runs keeps all words;
    repeated rows have equal results; an empty table gives no rows; other columns are not read.  A task holds a
    slice of texts or one longer text, and 4 bytes for each word left and each doubling of the longest piece.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        data, at = binary_view(batch.column(1))
        count, offsets, spans, best, collapsed = [], [0], [], [], []
        for lo, hi in slices(at):
            letters, byte, ids, first = split(data, at[lo : hi + 1])
            n = np.diff(first)
            row = np.repeat(np.arange(hi - lo), n)
            start, stop, q = runs_in(ids, row, least, times)
            lost = np.zeros(len(ids) + 1, np.int64)
            np.add.at(lost, start + q, 1)
            np.add.at(lost, stop, -1)
            kept = lost[:-1].cumsum() == 0
            size = np.diff(byte)
            width = np.where(kept, size + 1, 0)
            text = np.full(int(width.sum()), 32, np.uint8)
            into = np.cumsum(width) - width
            source = np.repeat(kept, size)
            text[(np.arange(len(letters)) + np.repeat(into - byte[:-1], size))[source]] = letters[source]
            ends = np.append(0, np.cumsum(width))[first]
            collapsed += [text[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            count += n.tolist()
            of = row[start]
            each = np.searchsorted(of, np.arange(hi - lo + 1))
            spans.append((start - first[of], stop - start, q))
            for a, b in zip(each[:-1], each[1:], strict=True):
                here = zip(*(x[a:b].tolist() for x in spans[-1]), strict=True)
                top = min(here, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                offsets.append(offsets[-1] + int(b - a))
        columns = [np.concatenate([s[k] for s in spans]) if spans else np.zeros(0, np.int64) for k in range(3)]
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
        return {"doc_id": batch.column(0), "n_words": pa.array(count, pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), "best": pa.array(best, runs.type), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, runs array<{SPAN}>, best {SPAN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, one text in ten (by the checksum of its id) with its last part replaced by repetitions; a null id has no digits, its row stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Java's expressions match white space as the contract has it
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long"))
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long"))

    def part(array: Column, start: Column, length: Column) -> Column:
        return F.slice(array, start.cast("int"), length.cast("int"))

    n, a, p, w = (F.col(c) for c in "napw")
    cycles = F.flatten(F.array_repeat(part(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    again = F.concat(part(w, F.lit(1), a), part(cycles, F.lit(1), n - a))
    return period.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """find() on planted() texts: the best run, and checksums of all runs and of what is left."""
    out = find(planted(docs))
    b = F.col("best")
    line = lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"), milli.alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The checksum of RFC 1952 of a few digits, byte by byte through its table of remainders.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: xor(r >> 8, crc.t[(xor(r, c) & 255) + 1]))"

ORACLE = f"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor({_CRC}, 4294967295) AS h FROM documents, crc),
e AS MATERIALIZED (SELECT doc_id, w, h, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
f AS MATERIALIZED (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w, n FROM e),
t AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM f),
m AS (SELECT s.doc_id, s.i, u.i - s.i AS q FROM t s JOIN t u ON s.doc_id = u.doc_id AND s.x = u.x AND u.i > s.i AND u.i - s.i <= s.n // 4),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM m),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, z) WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (length * 1000000000::HUGEINT) // period DESC, start, period) = 1),
a AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM r GROUP BY ALL),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND i >= start + period AND i < start + length) GROUP BY ALL)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(a.s, '')) AS runs_sha256, sha256(coalesce(k.s, '')) AS collapsed_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
