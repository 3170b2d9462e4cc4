"""Sharding by minimax contiguous partition.

Equal texts form atomic groups, ordered by a 128-bit hash. A binary search finds the
smallest capacity with which a greedy pass over the ordered group sizes needs no more
than the wanted shards, and the cuts lie where that pass makes them. The groups stay
distributed: the driver sees sums over key ranges and refines only the ranges in
which a cut can lie, until those hold at most ``window_groups`` groups. The result is
that of a search over all group sizes.

Defined results: a null text counts as an empty one; repeated rows each get a slot; with
fewer groups than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table


def greedy(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Starts of the shards when each takes as many items as fit; None if they don't suffice."""
    ends, starts, at, base = np.cumsum(sizes), [], 0, 0
    while at < len(sizes):
        if len(starts) == shards:
            return None
        starts.append(at)
        to = int(np.searchsorted(ends, base + capacity, "right"))
        if to == at:
            return None
        at, base = to, int(ends[to - 1])
    return starts


def smallest_capacity(sizes: np.ndarray, shards: int, low: int = 0) -> int:
    low, high = max(low, int(sizes.max(initial=0))), int(sizes.sum())
    low = max(low, -(-high // shards))
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _windows(sizes: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Which ranges can hold a cut of any greedy pass whose capacity lies in low..high."""
    ends = np.cumsum(sizes)
    can = np.zeros(len(sizes), bool)
    least = most = 0
    for _ in range(shards - 1):
        a, b = int(np.searchsorted(ends, least + low, "right")), int(np.searchsorted(ends, most + high, "right"))
        can[a : min(b, len(sizes) - 1) + 1] = True
        least, most = (int(ends[a - 1]) if a else 0), min(most + high, int(ends[-1]))
    return can


def minimax_cuts(groups: DataFrame, shards: int, window_groups: int = 50_000, bits: int = 12) -> tuple[int, list[tuple[int, int]]]:
    """The least capacity, and the key (h1, h2) of each shard's first group but the first shard's.

    ``groups``: h1, h2 (long, a unique key and the order) and bytes (long, over 0).
    """
    totals = groups.agg(F.max("bytes"), F.sum("bytes")).first()
    if totals[0] is None:
        return 0, []
    shift = 64 - bits

    def summed(rows: DataFrame, shift: int) -> list[list[int]]:
        found = rows.groupBy(F.shiftright("h1", shift).alias("k")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return [[int(r["k"]) << shift, int(r["b"]), int(r["n"]), shift] for r in found]

    ranges = sorted(summed(groups, shift))
    while True:
        sizes = np.array([r[1] for r in ranges], np.int64)
        low = max(int(totals[0]), -(-int(totals[1]) // shards))
        can = _windows(sizes, low, max(low, smallest_capacity(sizes, shards)), shards)
        wide = [r for r, c in zip(ranges, can, strict=True) if c and r[3] > 0]
        if sum(r[2] for r in wide) <= window_groups:
            break
        shift = max(0, shift - bits)
        inside = F.lit(False)
        for s in {r[3] for r in wide}:
            inside |= F.shiftright("h1", s).isin([r[0] >> s for r in wide if r[3] == s])
        ranges = sorted([r for r, c in zip(ranges, can, strict=True) if not (c and r[3] > 0)] + summed(groups.where(inside), shift))
    inside = F.lit(False)
    for s in {r[3] for r, c in zip(ranges, can, strict=True) if c}:
        inside |= F.shiftright("h1", s).isin([r[0] >> s for r, c in zip(ranges, can, strict=True) if c and r[3] == s])
    single = [(int(r["h1"]), int(r["h2"]), int(r["bytes"])) for r in groups.where(inside).select("h1", "h2", "bytes").collect()]
    whole = [(r[0], -(1 << 63), r[1]) for r, c in zip(ranges, can, strict=True) if not c]
    items = sorted(single + whole)
    sizes = np.array([x[2] for x in items], np.int64)
    capacity = smallest_capacity(sizes, shards, int(totals[0]))
    return capacity, [items[k][:2] for k in greedy(sizes, capacity, shards)[1:]]


def shard_of(h1: Column, h2: Column, cuts: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for a, b in cuts:
        out = out + F.when((h1 > a) | ((h1 == a) & (h2 >= b)), 1).otherwise(0)
    return out.cast("int")


def numbered(rows: DataFrame, by: str, key: list[str], cells: int = 1024) -> DataFrame:
    """Adds ``slot``, 0, 1, ... within each ``by``: rows are numbered within hashed cells, and the few cell counts give each cell's first number."""
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*key), F.lit(cells)).cast("int"))
    counts = rows.groupBy(by, "cell").agg(F.count("*").alias("n"))
    first = counts.select(by, "cell", (F.sum("n").over(Window.partitionBy(by).orderBy("cell")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by, "cell").orderBy(*key))
    return rows.withColumn("rank", rank).join(F.broadcast(first), [by, "cell"]).withColumn("slot", (F.col("first") + F.col("rank") - 1).cast("bigint")).drop("first", "rank", "cell")


def op6_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    rows = cut(rows)
    _, cuts = minimax_cuts(cut(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))), shards)
    placed = numbered(rows.withColumn("shard", shard_of(F.col("h1"), F.col("h2"), cuts)), "shard", ["doc_id", "h1", "h2"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
