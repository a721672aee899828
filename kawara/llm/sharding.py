"""Balanced shards by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kawara.operators.durable import numbered

from .common import durable, free

#: Up to so many different sizes their places are broadcast.
BROADCAST_SIZES = 1 << 14


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard takes, if each goes to the least-loaded shard (of equals the
    first) through a heap. ``loads`` are the shards' own before. Groups of no size are dealt in turn.
    """
    shards = len(loads)
    if not size:
        return [count // shards + (s < count % shards) for s in range(shards)]
    if count <= shards:
        heap, out = [(n, s) for s, n in enumerate(loads)], [0] * shards
        heapq.heapify(heap)
        for _ in range(count):
            n, s = heap[0]
            out[s] += 1
            heapq.heapreplace(heap, (n + size, s))
        return out
    # a heap takes the smallest of load + 0, 1, 2 ... * size: all those under some load, and the first few of just that
    taken = lambda level: [max(0, -(-(level - n) // size)) for n in loads]
    low, high = min(loads), max(loads) + size * count + 1
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if sum(taken(level)) <= count else (low, level)
    out = taken(low)
    left = count - sum(out)
    for s, n in enumerate(loads):
        if left and n <= low and (low - n) % size == 0:
            out[s] += 1
            left -= 1
    return out


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int]]]:
    """For (size, count), by falling size: (size, groups before it, shares), where the first ``shares[0]`` of its groups
    go to shard 0 and those up to ``shares[s]`` to shard s. Loads are those of a heap over all groups one by one."""
    loads, before, out = [0] * shards, 0, []
    for size, count in sorted(sizes, reverse=True):
        given = deal(loads, size, count)
        loads = [n + k * size for n, k in zip(loads, given)]
        out.append((size, before, [sum(given[: s + 1]) for s in range(shards)]))
        before += count
    return out


def shard(docs: DataFrame, shards: int, *, group_cols: list[str], size_col: str = "size", order_col: str = "doc_id", slot_rows: int = 1 << 17) -> DataFrame:
    """``docs`` with shard (from 0) and slot (from 0 within the shard, gapless): near-equal sums of ``size_col``.

    Rows equal in ``group_cols`` (nulls equal each other) stay together. All groups, however many and small, go by
    falling size to the least-loaded shard through a heap. Groups of one size can take each other's places, so what is
    scheduled are the different sizes with their counts, at most the square root of twice the total size and one more,
    as they add up to no more than that; the heap deals a size's groups at once, and which group is where among its
    size comes from a running number by ranges. So the result is the schedule itself, whatever the data, and a shard
    passes its fair share by at most the last group that it takes. A group larger than a shard's fair share makes its
    shard the largest; no split could keep it together. Null sizes count as 0. Slots are numbered within ranges of
    about ``slot_rows`` and shifted by the counts before. No rows, no rows; columns named shard or slot are replaced.
    """
    docs = durable(docs.drop("shard", "slot"))
    spark = docs.sparkSession
    group, bulk, lot, before, row, place = free(docs, "group", "bulk", "lot", "before", "row", "place")
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    docs = docs.withColumn(group, F.sha2(F.to_json(F.struct(*[F.col(c) for c in group_cols])), 256))
    groups = durable(docs.groupBy(group).agg(F.sum(size).alias(bulk), F.count("*").alias(row)))
    rows = groups.agg(F.sum(row)).first()[0]
    sizes = [tuple(r) for r in groups.groupBy(bulk).count().collect()]  # bounded as said above
    of = spark.createDataFrame(schedule(sizes, shards), f"{bulk} long, {before} long, shares array<long>")
    placed = numbered(groups.select(group, bulk), [F.col(bulk).desc(), F.col(group)], place, 0, written=True)
    placed = placed.join(F.broadcast(of) if len(sizes) <= BROADCAST_SIZES else of, bulk)
    placed = placed.select(group, F.size(F.filter("shares", lambda n: n <= F.col(place) - F.col(before))).alias("shard"))
    lots = max(1, -(-(rows or 0) // (shards * slot_rows)))
    placed = durable(docs.join(placed, group).withColumn(lot, F.pmod(F.monotonically_increasing_id(), F.lit(lots))))  # written at once, so a lot is what it was dealt
    counts = placed.groupBy("shard", lot).agg(F.count("*").alias(row))
    counts = counts.withColumn(before, F.sum(row).over(Window.partitionBy("shard").orderBy(lot).rowsBetween(Window.unboundedPreceding, -1))).select("shard", lot, F.coalesce(before, F.lit(0)).alias(before))
    number = F.row_number().over(Window.partitionBy("shard", lot).orderBy(F.col(order_col), F.col(group)))
    return placed.withColumn(row, number).join(counts, ["shard", lot]).withColumn("slot", (F.col(before) + F.col(row) - 1).cast("long")).drop(group, lot, before, row)
