"""Benchmark decontamination by winnowing, in DataFrame operations only.

A span of ``window`` words holds window - k + 1 hashed k-grams.  Of each such span the least hash is kept
as a fingerprint, from documents and items alike, so every shared span of ``window`` words has a common
fingerprint.  Documents' fingerprints are joined to the items', and each hit is extended in both directions
as far as words are equal in a full window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import sized, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A fingerprint holds the upper bits of a hash and, below them, the place of its k-gram.
PLACE_BITS = 28


def word_list(text: Column) -> Column:
    """Words of 0-9, a-z and all characters beyond ASCII, after lower-casing A-Z; none for null."""
    lower = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def _places(hashes: str, k: int) -> str:
    """SQL for the k-grams of an array of word hashes, as numbers whose lower bits are their places from 1."""
    parts = ", ".join(f"{hashes}[i + {j - 1}]" for j in range(k))
    return f"transform(sequence(1, size({hashes}) - {k - 1}), i -> (xxhash64({parts}) & {(1 << 63) - (1 << PLACE_BITS)}) | i)"


def _fingerprints(frame: DataFrame, window: int, k: int) -> DataFrame:
    """Adds fps to a frame with an array of words: the winnowed k-grams of texts with a window, none for others."""
    spans = window - k + 1
    least = ", ".join(f"grams[i + {j - 1}]" for j in range(spans))
    picked = "array_distinct(transform(sequence(1, size(grams) - %d), i -> %s))" % (spans - 1, f"least({least})" if spans > 1 else "grams[i - 1]")
    return (
        frame.withColumn("hashes", F.when(F.size("words") >= window, F.expr("transform(words, w -> xxhash64(w))")))
        .withColumn("grams", F.expr(_places("hashes", k)))
        .withColumn("fps", F.coalesce(F.expr(picked), F.array().cast("array<bigint>")))
        .drop("hashes", "grams")
    )


def _same(frame: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """frame joined on doc_id and text_hash, of which doc_id may be null, with keys and the columns that keys has besides."""
    keys = keys.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    return frame.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), how).drop("_d", "_t")


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, most_broadcast: int = 500_000, most_hits: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, n_words) and hit windows (doc_id, text_hash, item_id, start, length).

    Items shorter than a window are one window of their own length: those of each such length are found by
    all spans of it.  Their fingerprints are broadcast up to ``most_broadcast`` and joined by a shuffle beyond, hits likewise up to ``most_hits``.
    """
    worded = items.where("item_id is not null").select("item_id", word_list(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    lengths = sorted(r[0] for r in worded.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect())
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), word_list(F.col("text")).alias("words"))
    of = F.bitwise_not(F.lit((1 << PLACE_BITS) - 1).cast("long"))
    doc_side, item_side = keyed, []
    # explode_outer: for explode the optimiser would test the arrays' sizes first, with all that makes them copied into the test
    fps: list[Column] = [F.array(F.size("words").cast("long").bitwiseOR(F.lit(-1 << 62)))]  # every document has this one: its number of words
    for n in lengths:
        size, here = min(k, n), F.col("words")
        doc_side = _fingerprints(doc_side, n, size).withColumnRenamed("fps", f"fps{n}")
        fps.append(F.expr(f"transform(fps{n}, x -> named_struct('n', {n}, 'fp', x))"))
        mine = worded.where(F.size(here) >= n if n == window else F.size(here) == n)
        item_side.append(_fingerprints(mine, n, size).select("item_id", F.lit(n).alias("n"), F.explode_outer("fps").alias("fp")).where("fp is not null"))
    fps[0] = F.transform(fps[0], lambda x: F.struct(F.lit(0).alias("n"), x.alias("fp")))
    each = doc_side.select("doc_id", "text_hash", F.explode_outer(F.concat(*fps)).alias("f")).select("doc_id", "text_hash", "f.n", F.col("f.fp").bitwiseAND(of).alias("h"), F.col("f.fp").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("place"))
    if item_side:
        prints = reduce(DataFrame.unionByName, item_side).select("n", F.col("fp").bitwiseAND(of).alias("h"), "item_id", F.col("fp").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("item_place"))
        prints = prints if prints.count() > most_broadcast else F.broadcast(prints)
        each = each.join(prints, ["n", "h"], "left").where("n = 0 or item_id is not null")
    else:
        each = each.withColumns({"item_id": F.lit(None).cast("long"), "item_place": F.lit(0)})
    found = stored(each.select("doc_id", "text_hash", "n", "place", "item_id", "item_place"), "winnow")
    counted = found.where("n = 0").select("doc_id", "text_hash", F.col("place").cast("long").alias("n_words"))
    touched = found.where("n > 0").distinct()
    # texts that have hits, by broadcasts as long as hits are few; only those are cut into words again
    keys = sized(touched.select("doc_id", "text_hash").distinct(), most_hits)
    texts = _same(docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text_hash", "text"), keys)
    texts = texts.select("doc_id", "text_hash", word_list(F.col("text")).alias("words"))
    sides = worded.select("item_id", F.col("words").alias("item_words"))
    sides = F.broadcast(sides) if item_side and worded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= 4 * most_broadcast else sides
    # a window that holds the k-gram starts at most n - k words before it, within both texts: so many words around are enough of either
    room = F.col("n") - F.least(F.lit(k), F.col("n"))

    def around(place: str, words: str, name: str) -> list[Column]:
        first = F.greatest(F.col(place) - room, F.lit(1))
        return [first.alias(f"{name}_from"), F.slice(words, first, F.col(place) + F.col("n") - first).alias(name), F.size(words).alias(f"{name}_size")]

    key = ["doc_id", "text_hash", "item_id", "n", "place", "item_place"]
    spans = _same(texts, sized(touched, most_hits), "inner").select(*key, *around("place", "words", "near"))
    spans = spans.join(sides, "item_id").where((F.col("n") == window) | (F.size("item_words") == F.col("n")))
    spans = spans.select(*key, "near", "near_from", "near_size", *around("item_place", "item_words", "item"))
    away = F.col("place") - F.col("item_place")
    low = F.greatest("near_from", F.col("item_from") + away)
    high = F.least("place", F.col("near_size") - F.col("n") + 1, F.col("item_size") - F.col("n") + 1 + away)
    equal = "filter(sequence(low, high), s -> slice(near, s - near_from + 1, n) = slice(item, s - away - item_from + 1, n))"
    spans = spans.withColumns({"low": low, "high": high, "away": away}).where("low <= high")
    return counted, spans.select("doc_id", "text_hash", "item_id", F.explode(F.expr(equal)).alias("start"), F.col("n").alias("length"))


def report(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    A null text or one without words has no hits; null items and items without words are passed over; equal
    rows are counted each by itself; without documents there are no rows, without items no hits.  Rows with
    one id and different texts are kept apart; other columns are not read.
    """
    counted, found = hits(spark, docs, items, window, k)
    found = stored(found.distinct(), "winnow")
    key = ["doc_id", "text_hash"]
    places = found.select(*key, F.explode(F.expr("sequence(start, start + length - 1)")).alias("p")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    named = found.groupBy(*key).agg(names.alias("names")).select(*key, F.size("names").cast("long").alias("n_items"), F.concat_ws(",", "names").alias("names"))
    out = _same(counted, _same(places, named, "inner"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows, with all their columns, that have no window of an item; items without an id count as well."""
    _, found = hits(spark, docs, items.select(F.xxhash64("text").alias("item_id"), "text"), window, k)
    dirty = stored(found.select("doc_id", "text_hash").distinct(), "winnow")
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))  # no name of docs can clash with another
    return _same(whole, dirty, "left_anti").select("_row.*")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, s, array_to_string(list_slice(w, s, s + l - 1), ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hit AS (SELECT DISTINCT doc_id, s, l, item_id FROM dw JOIN iw USING (g, l)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
