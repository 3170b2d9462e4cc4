"""Benchmark decontamination by greedy string tiling.

Items and documents are words (lower-cased, without marks at their edges). Runs of
``min_match`` words are fingerprinted with a rolling Karp-Rabin hash; these seeds are joined, so that a document meets
only the items with which it shares one. For each such pair the longest match that uses no marked
word on either side is marked, again and again, until none of ``min_match`` words is left; so
passages whose parts come in another order are still covered. A document is contaminated
by an item when the tiles cover ``threshold`` of the item's words. Items shorter than
``min_match`` are matched whole.

Documents are read once and only those with a seed travel: where the items have at most ``most_marks``
different seeds, these (8 bytes each) go to every task and a document sends what it shares with them; beyond that
it sends all its seeds to the join. The items' words are broadcast up to ``most_broadcast`` of them, and joined beyond that.
Seeds of a pair are expanded in steps of bounded size and kept as runs on diagonals, so that texts that repeat
a word over and over need memory for their runs only. Every document of every length is searched.

Defined results: null and empty texts or items match nothing; repeated documents give a row
each, and so do documents under one or no doc_id; items that are repeated are reported under each item_id; of equally
long matches the first in the document, then in the item, is marked first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import arrow_map, binaries, cut, table, tidy, words_of

EDGES = b".,;:!?|*$%&#\"'()[]<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words without marks at their edges."""
    words = [w for w in (w.strip(EDGES) for w in words_of(text)) if w]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of each run of ``size`` words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + words[k : k + len(out)]
    return out


def _runs(doc: np.ndarray, item: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest runs of equal words, as start in doc, start in item and words. Places in the item are taken in steps with about ``most`` seeds each."""
    own, theirs = fingerprints(doc, size), fingerprints(item, size)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    low, high = np.searchsorted(ranked, theirs, "left"), np.searchsorted(ranked, theirs, "right")
    per = high - low
    upto = np.cumsum(per)
    made: list[list[np.ndarray]] = []
    begin = 0
    while begin < len(theirs):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + most, "right")))
        n = per[begin:end]
        to = np.repeat(np.arange(begin, end), n)
        at = order[np.repeat(low[begin:end], n) + np.arange(len(to)) - np.repeat(np.cumsum(n) - n, n)]
        same = np.ones(len(at), bool)
        for k in range(size):
            same &= doc[at + k] == item[to + k]
        at, to = at[same], to[same]
        by = np.lexsort((to, to - at))
        at, to = at[by], to[by]
        if len(at):
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1] + 1)))
            made.append([at[first], to[first], np.diff(np.append(first, len(at)))])
        begin = end
    if not made:
        return (np.empty(0, np.int64),) * 3
    at, to, seeds = (np.concatenate(x) for x in zip(*made, strict=True))
    by = np.lexsort((to, to - at))  # a run goes on where the last step ended
    at, to, seeds = at[by], to[by], seeds[by]
    first = np.flatnonzero(np.append(True, (to[1:] - at[1:] != to[:-1] - at[:-1]) | (to[1:] != to[:-1] + seeds[:-1])))
    return at[first], to[first], np.add.reduceat(seeds, first) + size - 1


def _free(used: np.ndarray, taken: np.ndarray, i: int, j: int, n: int, size: int) -> list[tuple[int, int, int]]:
    """The parts of a run that no mark touches, of ``size`` words and more."""
    marked = used[i : i + n] | taken[j : j + n]
    if not marked.any():
        return [(i, j, n)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]])))
    return [(i + int(a), j + int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= size]


def tiles(doc: np.ndarray, item: np.ndarray, size: int, most: int = 1 << 20) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in doc, start in item, words), longest first. ``most``: seeds that are expanded at a time."""
    at, to, words = _runs(doc, item, size, most)
    heap = list(zip((-words).tolist(), at.tolist(), to.tolist(), strict=True))
    heapq.heapify(heap)
    used, taken, found = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        parts = _free(used, taken, i, j, -n, size)
        if parts == [(i, j, -n)]:
            found.append((i, j, -n))
            used[i : i - n] = taken[j : j - n] = True
        else:
            for i, j, n in parts:
                heapq.heappush(heap, (-n, i, j))
    return found


def _seeds(items: DataFrame, size: int) -> DataFrame:
    """(item, item_id, words, marks): an item's words and its distinct seeds, packed; ``size``: words of a seed, fewer for shorter items."""
    ship(items.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            words = [tokens(x) for x in binaries(batch.column(1))]
            marks = [np.unique(fingerprints(x, min(size, len(x)))) if len(x) else np.empty(0, np.uint64) for x in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(words))), batch.column(0).cast(pa.int64()), pa.array(list(map(len, words)), pa.int32()), pa.array([x.tobytes() for x in words], pa.binary()), pa.array([x.astype(np.int64) for x in marks], pa.list_(pa.int64()))],
                ["item", "item_id", "n", "words", "marks"],
            )
            number += len(words)

    return items.mapInArrow(tidy(run), "item bigint, item_id bigint, n int, words binary, marks array<bigint>").where("n > 0")


def _marks(items: DataFrame, most: int) -> np.ndarray | None:
    """All different seeds of the items in order, if there are at most ``most``."""
    seeds = items.select(F.explode("marks").alias("mark")).distinct()
    if seeds.count() > most:
        return None
    packed = lambda batch: pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(0)).tobytes()], pa.binary())], ["marks"])
    found = [np.frombuffer(bytes(r["marks"]), np.int64).astype(np.uint64) for r in arrow_map(seeds, packed, "marks binary").collect()]
    return np.sort(np.concatenate([*found, np.empty(0, np.uint64)]))


def _candidates(rows: DataFrame, sizes: list[int], known: np.ndarray | None) -> DataFrame:
    """(row, doc_id, words, marks): documents and their seeds, of which only those in ``known`` count if that is given."""
    ship(rows.sparkSession)
    kind = rows.dtypes[0][1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            hit, words, marks = [], [], []
            for k, text in enumerate(binaries(batch.column(1))):
                own = tokens(text)
                if len(own) < sizes[0]:
                    continue
                seeds = np.unique(np.concatenate([fingerprints(own, n) for n in sizes]))
                if known is not None:
                    at = np.searchsorted(known, seeds)
                    seeds = seeds[known[np.minimum(at, len(known) - 1)] == seeds]
                if len(seeds):
                    hit.append(k)
                    words.append(own.tobytes())
                    marks.append(seeds.astype(np.int64))
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(number + np.array(hit)), batch.column(0).take(pa.array(hit)), pa.array(words, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["row", "doc_id", "words", "marks"])
            number += batch.num_rows

    return rows.mapInArrow(tidy(run), f"row bigint, doc_id {kind}, words binary, marks array<bigint>")


_SPANS = "array<struct<doc_at:int,item_at:int,words:int>>"


def matches(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, most_marks: int = 1 << 20, most_broadcast: int = 1 << 20) -> DataFrame:
    """A row for each contaminated (doc_id, item_id): item_words, tiled_words, coverage, spans (word positions in both, longest first)."""
    rows = docs.select("doc_id", "text")
    items = cut(_seeds(benchmark.select("item_id", "text"), min_match))
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(min_match))).distinct().collect())
    out = f"doc_id {rows.dtypes[0][1]}, item_id bigint, item_words int, tiled_words int, coverage double, spans {_SPANS}"
    if not sizes:
        return rows.sparkSession.createDataFrame([], out)
    known = _marks(items, most_marks)
    small = known is not None and (items.agg(F.sum("n")).first()[0] or 0) <= most_broadcast
    near = F.broadcast if small else lambda df: df
    found = cut(_candidates(rows, sizes, known))
    seeds = items.select("item", F.explode("marks").alias("mark"))
    pairs = found.select("row", F.explode("marks").alias("mark")).join(near(seeds), "mark").select("row", "item").distinct()
    both = pairs.join(found.select("row", "doc_id", F.col("words").alias("doc")), "row").join(near(items.select("item", "item_id", F.col("words").alias("own"))), "item")
    span = pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))

    def tiled(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        made, owner = [], []
        for k in range(batch.num_rows):
            doc, own = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (1, 3))
            marked = tiles(doc, own, min(min_match, len(own)))
            covered = sum(x[2] for x in marked)
            if covered >= threshold * len(own):
                owner.append(k)
                made.append((len(own), covered, covered / len(own), [dict(zip(("doc_at", "item_at", "words"), x, strict=True)) for x in marked]))
        if not made:
            return None
        columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.float64(), span), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), *columns], ["doc_id", "item_id", "item_words", "tiled_words", "coverage", "spans"])

    return arrow_map(both.select("doc_id", "doc", "item_id", "own"), tiled, out)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "tiled_words", F.round("coverage", 6).alias("coverage"), F.size("spans").alias("n_tiles"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go.

    Rows are judged by their text, so null or repeated ids don't matter; rows with one text go together, and rows
    without a text stay. Other columns pass through under whatever name.
    """
    digest = F.md5("text")
    hit = matches(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__digest")).distinct()
    return docs.join(hit, digest == F.col("__digest"), "left_anti").select(*docs.columns)
