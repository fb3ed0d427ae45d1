"""Sharding by Karmarkar-Karp differencing.

Rows with equal texts form an indivisible group.  Small groups are hashed into a fixed number of
bundles, groups above a share of all bytes stay items of their own, so the number of items is bounded
by parameters, whatever the input.  Differencing starts from one k-tuple of loads per item and always
combines the two partial partitions of largest spread, the heavy parts of one with the light parts of
the other, until a single partition is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def karmarkar_karp(weights: Sequence[int], shards: int) -> list[int]:
    """The shard of each item; spreads of equal size are combined in the order of the items."""
    if shards < 1:
        raise ValueError("there must be a shard")
    # a partition: loads in falling order, relative to the least, and the items of each load as trees
    heap = [(-w, i, (w,) + (0,) * (shards - 1), ((i,),) + ((),) * (shards - 1)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    if not heap:
        return []
    ticket = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        joined = sorted(((a[k] + b[-1 - k], k) for k in range(shards)), reverse=True)
        least = joined[-1][0]
        loads = tuple(load - least for load, _ in joined)
        heapq.heappush(heap, (least - joined[0][0], ticket, loads, tuple((x[k], y[-1 - k]) for _, k in joined)))
        ticket += 1
    out = [0] * len(weights)
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            node = stack.pop()
            for part in node:
                if isinstance(part, int):
                    out[part] = shard
                else:
                    stack.append(part)
    return out


def shard(docs: DataFrame, shards: int = 8, bundles: int = 1024, heavy_share: int = 64, lanes: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law ``bytes``.

    size is the text's UTF-8 bytes plus 1; a null text has none, goes with the empty ones and has
    their checksum 0.  Equal texts share a shard, so a group larger than a shard's part makes its
    shard larger than the rest and the others share what is left.  heavy_share: a group of more than
    1 / (shards * heavy_share) of all bytes is an item of its own (at most shards * heavy_share of
    them).  Slots run from 0 in every shard: rows are numbered within ``lanes`` hashed parts of a
    shard, which follow each other.  Repeated rows get slots of their own; an empty table gives no
    rows; other columns are not read, and null ids are kept.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_key"))
    groups = rows.groupBy("_key").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    least = max(1, total // (shards * heavy_share))
    bundle = F.pmod(F.xxhash64("_key"), F.lit(bundles)).cast("int")
    heavy = F.col("bytes") > least
    items = groups.groupBy(F.when(heavy, F.col("_key")).alias("heavy_key"), F.when(~heavy, bundle).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    found = sorted(items.collect(), key=lambda r: (-r.bytes, r.heavy_key or "", r.bundle or 0))  # at most bundles + shards * heavy_share
    parts = karmarkar_karp([r.bytes for r in found], shards)
    heavies = [(r.heavy_key, p) for r, p in zip(found, parts, strict=True) if r.heavy_key is not None]
    by_bundle = [0] * bundles
    for r, p in zip(found, parts, strict=True):
        if r.heavy_key is None:
            by_bundle[r.bundle] = p
    dealt = rows.join(F.broadcast(spark.createDataFrame(heavies, "_key string, _heavy int")), "_key", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("_heavy", F.element_at(F.array(*map(F.lit, by_bundle)), bundle + 1)).alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(lanes)).cast("int").alias("_lane")
    )
    counts = dealt.groupBy("shard", "_lane").count().collect()  # at most shards * lanes
    before, last = [], {}
    for r in sorted(counts):
        before.append((r.shard, r._lane, last.get(r.shard, 0)))
        last[r.shard] = last.get(r.shard, 0) + r["count"]
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("shard", "_lane").orderBy("doc_id", "text_crc32")) - 1)
    out = numbered.join(F.broadcast(spark.createDataFrame(before, "shard int, _lane int, _before long")), ["shard", "_lane"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_n") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
