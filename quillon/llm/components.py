"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import gathered, tidy

HEAVY = 4096
#: So many edges (4 MB) are finished by one task.
ALONE = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _shortened(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Each partition's edges as stars; a partition is as large as its shuffle made it, and nodes keep their components. ``roots``: also an edge from each star's middle to itself."""
    ship(edges.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = [np.empty(0, np.int64)] * 2, []
        for batch in batches:
            more.append([np.asarray(batch.column(k)) for k in range(2)])
            if sum(len(x) for x, _ in more) > len(held[0]):
                held, more = forest(*map(np.concatenate, zip(held, *more, strict=True))), []
        u, v = forest(*map(np.concatenate, zip(held, *more, strict=True)))
        if roots:
            u, v = (np.concatenate([x, np.unique(v)]) for x in (u, v))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(tidy(run), "u bigint, v bigint")


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with m of their u from ``least`` (u, m, degree), u unique and with every u of ``edges``.

    Nodes with more than a ``HEAVY``-th of all ``total`` rows, HEAVY at most, are broadcast, so that their edges stay where they are; the others meet by a shuffle.
    """
    heavy = least.where(F.col("degree") > max(64, total // HEAVY)).select("u", F.col("m").alias("known"))
    marked = edges.join(F.broadcast(heavy), "u", "left")
    rest = marked.where("known IS NULL").select("u", "v").join(least.select("u", "m"), "u")
    return rest.unionByName(marked.where("known IS NOT NULL").select("u", "v", F.col("known").alias("m")))


def components(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, label) for every end of a link; label is the smallest node reachable. ``links``: u, v (long).

    In each round a partition's edges first become stars by themselves. Then links are joined with the least
    neighbour of one end, those of a node with very many of them where they lie.
    Rounds are logarithmic in the size of a component. When ``alone`` edges or fewer are left, one task finishes them.
    """
    edges = links.where("u != v").select(F.col("u").cast("bigint"), F.col("v").cast("bigint"))
    state, rows = None, None
    while True:
        edges = gathered(_shortened(edges))
        rows = edges.count() if rows is None else rows  # later the count of the round before, which shortening only lowers
        if rows <= alone:
            return gathered(_shortened(edges.coalesce(1), roots=True)).select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = gathered(_with_least(both, least, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = _with_least(large, low, 2 * rows).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = gathered(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        found = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(found) == state:
            return new.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        edges, state, rows = new, tuple(found), found[0]
