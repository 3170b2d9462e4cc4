"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds the hashes of its distinct word shingles. Under a global order of all shingles
two sets with a Jaccard index of ``num / den`` or more share one among the first
``n - ceil(n * num / den) + 1`` of each, whatever the order. Under the first order (shingles that
many documents have come last) those prefixes are posted and meet by shingle, subject to the length
and position filters. Of a candidate the longer prefixes under a second order, kept with the document's
id, must then leave room for the overlap that is needed, and what is left must share prefix
shingles under a third before its sets are compared in full.

Equal sets are one class from the start and are compared once. A shingle's list of up to
``small`` classes gives all its pairs. In a longer one every class is first compared with
the list's most central classes (those with the shingle nearest the front), in its part of the list and in the whole; after these
links the classes of the list that are still in different components are compared, all of them, in
tiles of bounded size, so that the components are exact. Last, within each component all
classes of long lists are intersected with each other, again in tiles, by matrix products of their shingles, and each tile
says how many links a class has in it; so every link is counted, whatever the length of a list, and none of these is written out. Lists of very common shingles are salted.

Defined results: a text with fewer than ``width`` words is one shingle of all its words; a null
text, or one without words, has an empty set and is its own component; repeated rows
get a row each; rows of one doc_id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, binaries, cut, gathered, table, tidy, words_of
from .components import components
from ..runtime import ship

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors that make two further global orders of the same hashes.
_ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
SALTS = 64
FILTER_BITS = 23
SURVEY_BYTES = 32 << 20


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ (out >> np.uint64(31))) * _BASE + h[i : i + len(out)]
        out = (out ^ (out >> np.uint64(29))) * _ORDERS[0]
    return np.unique(out)


def set_id(members: np.ndarray) -> int:
    """A class is known by this and its size."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).astype(np.int64))


class Threshold:
    """Jaccard index >= num / den."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den

    def prefix(self, n):
        return n - -(-n * self.num // self.den) + 1

    def overlap(self, a, b):
        """The least intersection that suffices."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def possible(self, n1, p1, n2, p2):
        """Length filter, and position filter for a first common shingle at p1 and p2."""
        fits = (self.den * np.minimum(n1, n2) >= self.num * np.maximum(n1, n2)) & True
        return fits & (np.minimum(n1 - p1, n2 - p2) >= self.overlap(n1, n2))

    def likely(self, n1: int, x: np.ndarray, n2: int, y: np.ndarray) -> bool:
        """Whether prefixes under the second order (sorted, from ``second``) leave room for the overlap that is needed."""
        if not len(x) or not len(y):
            return False
        x, y = x[: np.searchsorted(x, y[-1], "right")], y[: np.searchsorted(y, x[-1], "right")]
        at = np.searchsorted(y, x)
        same = int((y[np.minimum(at, max(len(y) - 1, 0))] == x).sum()) if len(y) else 0
        return same + min(n1 - len(x), n2 - len(y)) >= self.overlap(n1, n2)

    def holds(self, a: np.ndarray, b: np.ndarray) -> bool:
        """The third order's prefixes, then the sets themselves."""
        pa_, pb = self.prefix(len(a)), self.prefix(len(b))
        with np.errstate(over="ignore"):
            x, y = np.partition(a * _ORDERS[1], pa_ - 1)[:pa_], np.partition(b * _ORDERS[1], pb - 1)[:pb]
        if not len(np.intersect1d(x, y, assume_unique=True)):
            return False
        return len(np.intersect1d(a, b, assume_unique=True)) >= self.overlap(len(a), len(b))


def second(members: np.ndarray, share: float = 0.4) -> np.ndarray:
    """The first members under the second order, as the upper half of their places in it."""
    size = min(len(members), 8 + int(share * len(members)))
    with np.errstate(over="ignore"):
        place = members * _ORDERS[0]
    if size < len(members):
        place = np.partition(place, size - 1)[:size]
    return np.sort(place >> np.uint64(32)).astype(np.uint32)


def _surveyed(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: (id, set, n, second) of each document; kind 1: for each Arrow batch the shingles it has twice or more, with their counts, packed in ``second``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, width) for x in binaries(batch.column(1))]
        every = np.concatenate(sets)
        every.sort()
        value, count = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
        count = (count + 1).astype(np.uint32)
        del every
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*[0] * len(sets), 1], pa.int32()),
                pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.nulls(1, pa.int64())]),
                pa.array([*map(set_id, sets), 0], pa.int64()),
                pa.array([*map(len, sets), len(value)], pa.int64()),
                pa.array([*(second(x).tobytes() for x in sets), value.tobytes() + count.tobytes()], pa.binary()),
            ],
            ["kind", "id", "hash", "n", "second"],
        )

    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, as the planner knows it
    docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, min(size // SURVEY_BYTES, 1 << 20)))  # small files don't make small counts
    return arrow_map(docs, step, "kind int, id bigint, hash bigint, n bigint, second binary")


def _common(survey: DataFrame, least: int, most: int) -> np.ndarray:
    """Common shingles, rarest first. Only counts of two and more in a batch are known, which finds what many documents share; these only shape the order, and their number is bounded."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(np.frombuffer(x[: 8 * n], np.int64), np.frombuffer(x[8 * n :], np.uint32)) for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        value, count = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int64))], ["hash", "n"])

    counts = arrow_map(survey.where("kind = 1").select("n", "second"), step, "hash bigint, n bigint")
    found = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(most)
    count, value = _packed(found.select("n", "hash"))
    return value[np.lexsort((value, -count))][::-1].astype(np.uint64)


def _packed(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of whole numbers for the driver, 16 bytes a row. ``pairs`` is small by its own bound."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.stack([np.asarray(batch.column(k)) for k in range(2)]).astype(np.int64).tobytes()], pa.binary())], ["data"])

    found = [np.frombuffer(bytes(r["data"]), np.int64).reshape(2, -1) for r in arrow_map(pairs, step, "data binary").collect()]
    return tuple(np.concatenate([*found, np.empty((2, 0), np.int64)], axis=1))


class Order:
    """The first global order: by hash, then the common shingles by how common they are."""

    def __init__(self, common: np.ndarray):
        self.place = np.argsort(common)
        self.sorted = common[self.place]

    def prefix(self, members: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``size`` members, and which of them are common."""
        if not len(self.sorted):
            return members[:size], np.zeros(size, bool)
        at = np.minimum(np.searchsorted(self.sorted, members), len(self.sorted) - 1)
        often = self.sorted[at] == members
        rare = members[~often][:size]
        if len(rare) == size:
            return rare, np.zeros(size, bool)
        late = members[often][np.argsort(self.place[at[often]])][: size - len(rare)]
        return np.concatenate([rare, late]), np.arange(size) >= len(rare)


def _postings(docs: DataFrame, order: Order, t: Threshold, width: int) -> DataFrame:
    """(key, spot, set, shingle): spot holds position and size; shingle is set for common ones, whose key is salted."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        seen, out = set(), []
        for text in binaries(batch.column(1)):
            members = shingles(text, width)
            n = len(members)
            if not n or (who := (set_id(members), n)) in seen:
                continue
            seen.add(who)
            first, often = order.prefix(members, t.prefix(n))
            k = len(first)
            key = first.copy()
            if often.any():
                with np.errstate(over="ignore"):
                    key[often] = (first[often] ^ np.uint64(1 + who[0] % SALTS)) * _ORDERS[1]
            out.append((key, (np.arange(k) << 32) | n, np.full(k, who[0], np.int64), first, often))
        if not out:
            return None
        key, spot, who, first, often = map(np.concatenate, zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(spot.astype(np.int64)), pa.array(who), pa.array(first.astype(np.int64), mask=~often)], ["key", "spot", "set", "shingle"])

    return arrow_map(docs, step, "key bigint, spot bigint, set bigint, shingle bigint")


_FOUND = "kind int, shingle bigint, a bigint, na bigint, b bigint, nb bigint"
PAIR, MEMBER = 0, 1


def _emit(kind: int, shingle, a, na, b, nb) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (shingle, a, na, b, nb))], ["kind", "shingle", "a", "na", "b", "nb"])


def _meet(postings: DataFrame, t: Threshold, small: int) -> DataFrame:
    """Candidate pairs of each list; of long and of salted ones also the members."""
    ship(postings.sparkSession)

    def pairs(i: np.ndarray, j: np.ndarray, who, n, p) -> Iterator[pa.RecordBatch]:
        ok = t.possible(n[i], p[i], n[j], p[j]) & ((who[i] != who[j]) | (n[i] != n[j]))
        if ok.any():
            i, j = i[ok], j[ok]
            swap = (who[i] > who[j]) | ((who[i] == who[j]) & (n[i] > n[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield _emit(PAIR, *map(np.ascontiguousarray, np.unique(np.stack([np.zeros(len(i), np.int64), who[i], n[i], who[j], n[j]]), axis=1)))

    def lists(key, spot, who, shingle, often) -> Iterator[pa.RecordBatch]:
        """Whole lists, each with its most central classes first."""
        n, p = spot & 0xFFFFFFFF, spot >> 32
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        for size in range(2, small + 1):
            first = starts[(sizes == size) & ~often[starts]]
            if len(first):
                a, b = np.triu_indices(size, 1)
                yield from pairs((first[:, None] + a).ravel(), (first[:, None] + b).ravel(), who, n, p)
        for k in np.flatnonzero((sizes > small) | (often[starts] & (sizes > 0))):
            a, size = starts[k], sizes[k]
            rows = np.arange(a, a + size)
            for c in range(min(2, size)):
                yield from pairs(np.full(size - c - 1, a + c), rows[c + 1 :], who, n, p)
            name = np.full(size, shingle[a] if often[a] else key[a])
            yield _emit(MEMBER, name, who[rows], n[rows], p[rows], np.zeros(size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            key, spot, who = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            often = np.asarray(batch.column(3).is_valid())
            new = [key, spot, who, batch.column(3).fill_null(0).to_numpy(zero_copy_only=False), often]
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            fresh = np.append(True, (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1]) | (new[2][1:] != new[2][:-1]))[: len(new[0])]
            new = [x[fresh] for x in new]  # a class comes once from each batch that has it
            last = int(np.searchsorted(new[0], new[0][-1], "left")) if len(new[0]) else 0
            if last:
                yield from lists(*(x[:last] for x in new))
            held = [x[last:] for x in new]
            if len(held[0]) > 200_000:  # a very long list goes on with its first two rows, as one whose members are kept
                yield from lists(*held)
                key, spot, who, shingle, often = (x[:2] for x in held)
                held = [key, spot, who, np.where(often, shingle, key), np.ones_like(often)]
        if held is not None and len(held[0]):
            yield from lists(*held)

    return postings.mapInArrow(tidy(run), _FOUND)


def _centred(members: DataFrame, t: Threshold) -> DataFrame:
    """Each member of a long list with the list's most central class, over all salts."""
    centre = members.groupBy("shingle").agg(F.min(F.struct("p", "n", "set")).alias("c"))
    both = _beside(members, centre).where("set != c.set OR n != c.n")
    fits = (t.den * F.least("n", "c.n") >= t.num * F.greatest("n", "c.n")) & (F.least(F.col("n") - F.col("p"), F.col("c.n") - F.col("c.p")) >= F.ceil(t.num * (F.col("n") + F.col("c.n")) / (t.num + t.den)))
    low, high = F.least(F.struct("set", "n"), F.struct("c.set", "c.n")), F.greatest(F.struct("set", "n"), F.struct("c.set", "c.n"))
    return both.where(fits).select(low.alias("x"), high.alias("y")).select(F.col("x.set").alias("a"), F.col("x.n").alias("na"), F.col("y.set").alias("b"), F.col("y.n").alias("nb"))


def _beside(members: DataFrame, lists: DataFrame) -> DataFrame:
    """``members`` with the one row of their list in ``lists``: members are salted, and the lists' rows stand in for each salt."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("set", "n"), F.lit(SALTS)).cast("int"))
    return salted.join(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["shingle", "salt"]).drop("salt")


def _across(members: DataFrame, t: Threshold, tile: int = 2048) -> DataFrame:
    """All candidate pairs of different components within each list, in tiles. ``members``: shingle, set, n, p, label."""
    sizes = members.groupBy("shingle", "label").agg(F.count("*").alias("rows"))
    lists = sizes.groupBy("shingle").agg(F.max(F.struct("rows", "label")).alias("main"), F.sum("rows").alias("rows")).where("rows > main.rows")
    lists = lists.select("shingle", F.col("main.label").alias("main"), F.ceil((F.col("rows") - F.col("main.rows")) / tile).cast("int").alias("few"), F.ceil(F.col("main.rows") / tile).cast("int").alias("many"))
    # a list's largest component is not compared with itself: its tiles only meet those of the others, which come first
    rows, own = _beside(members, lists), F.col("label") == F.col("main")
    rows = rows.withColumn("block", F.when(own, F.col("few") + F.pmod(F.xxhash64("n", "set"), F.col("many"))).otherwise(F.pmod(F.xxhash64("n", "set"), F.col("few"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
    rows = rows.select("shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "n", "p", "label")
    rows = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    ship(members.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def group(x) -> Iterator[pa.RecordBatch]:
            _, i, j, block, who, n, p, label = x
            cross = i[0] != j[0]
            for a in range(len(who) - 1):
                b = np.arange(a + 1, len(who))
                ok = (label[b] != label[a]) & t.possible(n[a], p[a], n[b], p[b])
                if cross:
                    ok &= block[b] != block[a]
                if ok.any():
                    b = b[ok]
                    swap = (who[b] < who[a]) | ((who[b] == who[a]) & (n[b] < n[a]))
                    x1, n1, x2, n2 = np.where(swap, who[b], who[a]), np.where(swap, n[b], n[a]), np.where(swap, who[a], who[b]), np.where(swap, n[a], n[b])
                    yield _emit(PAIR, np.zeros(len(b)), x1, n1, x2, n2)

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            starts = np.flatnonzero(np.append(True, (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1]) | (new[2][1:] != new[2][:-1]))) if len(new[0]) else np.array([0])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield from group([x[a:b] for x in new])
            held = [x[starts[-1] :] for x in new]
        if held is not None and len(held[0]):
            yield from group(held)

    return rows.mapInArrow(tidy(run), _FOUND)


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """a, na, b, nb and the column of either set, as x and y. ``sets``: set, n (unique) and the column."""
    one = pairs.join(sets.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col(column).alias("x")), ["a", "na"])
    return one.join(sets.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y")), ["b", "nb"]).select("a", "na", "b", "nb", "x", "y")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("set"), F.col("nb").alias("n"))).distinct()


_PAIR = "a bigint, na bigint, b bigint, nb bigint"


def _likely(survey: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """The pairs that the second order leaves."""
    known = survey.where("kind = 0").select(F.col("hash").alias("set"), "n", "second")
    sets = known.join(_ends(pairs), ["set", "n"], "left_semi").groupBy("set", "n").agg(F.first("second").alias("second"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda k: [np.frombuffer(v, np.uint32) for v in batch.column(k).to_pylist()]
        sizes = zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
        ok = pa.array([t.likely(na, x, nb, y) for (na, nb), x, y in zip(sizes, read(4), read(5), strict=True)], pa.bool_())
        return batch.select([0, 1, 2, 3]).filter(ok)

    return arrow_map(_both(pairs, sets, "second"), compare, _PAIR)


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(set, n, members) of the classes in ``wanted``, made again from one document of each. A bitmap of fixed size lets the others pass by."""
    bit = F.pmod("rep", F.lit(1 << FILTER_BITS))
    words = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    marked = classes.join(wanted, ["set", "n"], "left_semi").select(F.shiftright(bit, 5).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(rep, {1 << FILTER_BITS}) & 31 AS INT))").alias("bits"))
    at, bits = _packed(marked.where("word IS NOT NULL").groupBy("word").agg(F.bit_or("bits").alias("bits")))
    words[at] = bits
    everyone = classes.where("rep IS NULL").limit(1).count() > 0  # a class whose documents have no id

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False) % (1 << FILTER_BITS)
        hit = (words[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
        if everyone:
            hit |= np.asarray(batch.column(0).is_null())
        out = {}
        for text in binaries(batch.column(1).filter(pa.array(hit))):
            members = shingles(text, width)
            if len(members):
                out[set_id(members), len(members)] = members.tobytes()
        if not out:
            return None
        who, n = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n, pa.int64()), pa.array(list(out.values()), pa.binary())], ["set", "n", "members"])

    sets = arrow_map(docs, step, "set bigint, n bigint, members binary").join(wanted, ["set", "n"], "left_semi")
    return gathered(sets.groupBy("set", "n").agg(F.first("members").alias("members")))


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, t: Threshold, width: int) -> DataFrame:
    """The pairs that hold, by full sets."""
    sets = _sets(docs, _ends(pairs), classes, width)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda k: [np.frombuffer(v, np.uint64) for v in batch.column(k).to_pylist()]
        ok = pa.array([t.holds(x, y) for x, y in zip(read(4), read(5), strict=True)], pa.bool_())
        return batch.select([0, 1, 2, 3]).filter(ok)

    return arrow_map(_both(pairs, sets, "members"), compare, _PAIR)


def _crowds(members: DataFrame, links: DataFrame, classes: DataFrame, label: DataFrame, rows: int, shingles: int) -> DataFrame:
    """(set, n, label, blocks) of the classes of long lists in components where not every pair of them is a known link."""
    listed = gathered(members.select("set", "n").distinct().join(classes, ["set", "n"]).join(label, F.col("rep") == F.col("node")).select("set", "n", "label"))
    one = links.join(listed.select(F.col("set").alias("a"), F.col("n").alias("na"), "label"), ["a", "na"])
    known = one.join(listed.select(F.col("set").alias("b"), F.col("n").alias("nb")), ["b", "nb"]).groupBy("label").agg(F.count("*").alias("known"))
    crowds = listed.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).join(known, "label", "left").where("rows * (rows - 1) / 2 > coalesce(known, 0)")
    return listed.join(crowds.select("label", F.ceil(F.greatest(F.col("rows") / rows, F.col("size") / shingles)).cast("int").alias("blocks")), "label")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """The sizes of the intersections of the sets at ``left`` with those at ``right``."""
    sizes = np.array(list(map(len, sets)))
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(value)
    owner = owner[by]
    start = np.append(True, value[by][1:] != value[by][:-1])
    place = np.cumsum(start) - 1
    often = np.bincount(place) > 1  # a shingle of one set is in no intersection
    keep = often[place]
    owner, place = owner[keep], (np.cumsum(often) - 1)[place[keep]]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64
    out = np.zeros((len(left), len(right)), kind)
    for c in range(0, int(often.sum()), width):
        a, b = np.searchsorted(place, [c, c + width])
        has = np.zeros((len(sets), min(width, int(often.sum()) - c)), kind)
        has[owner[a:b], place[a:b] - c] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def _within(docs: DataFrame, crowds: DataFrame, classes: DataFrame, t: Threshold, width: int) -> DataFrame:
    """(set, n, links): how many links each class of ``crowds`` has to others of its label, by full sets, a row for each tile; the links themselves are not written out."""
    rows = crowds.join(_sets(docs, crowds.select("set", "n"), classes, width), ["set", "n"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set", "n"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "n", "members")
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    ship(docs.sparkSession)

    def group(x: list) -> pa.RecordBatch:
        _, i, j, block, who, n, members = x
        left, right = (np.flatnonzero(block == k[0]) for k in (i, j))
        ok = common_counts([np.frombuffer(v, np.uint64) for v in members], left, right) >= t.overlap(n[left][:, None], n[right])
        if i[0] == j[0]:
            np.fill_diagonal(ok, False)
            at, times = left, ok.sum(1)
        else:
            at, times = np.concatenate([left, right]), np.concatenate([ok.sum(1), ok.sum(0)])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (who[at].astype(np.int64), n[at].astype(np.int64), times.astype(np.int64))], ["set", "n", "links"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            if not len(new[0]):
                continue
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            starts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in new[:3]], axis=0)))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield group([x[a:b] for x in new])
            held = [x[starts[-1] :].copy() for x in new]
        if held is not None:
            yield group(held)

    return rows.mapInArrow(tidy(run), "set bigint, n bigint, links bigint")


def join(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, small: int = 12, common: int = 24, most_common: int = 1 << 17, tile: tuple[int, int] = (1024, 1 << 18), count: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links_found (all links of its class).

    ``tile``: classes and shingles of a block within a component. Without ``count`` there is no n_links_found, and links within a component are not looked for.
    """
    t = Threshold(num, den)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    survey = cut(_surveyed(docs, width))
    members = survey.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("hash").alias("set"), "n")
    order = Order(_common(survey, common, most_common))
    postings = _postings(docs, order, t, width).repartition("key").sortWithinPartitions("key", "spot", "set")
    found = gathered(_meet(postings, t, small))
    members_of = found.where(F.col("kind") == MEMBER).select("shingle", F.col("a").alias("set"), F.col("na").alias("n"), F.col("b").alias("p"))
    between = _centred(members_of, t)
    tried = gathered(found.where(F.col("kind") == PAIR).select("a", "na", "b", "nb").unionByName(between).distinct())
    classes = gathered(members.where("n > 0").groupBy("set", "n").agg(F.min("doc_id").alias("rep")))
    links = gathered(_verified(docs, gathered(_likely(survey, tried, t)), classes, t, width))
    label = _labels(links, classes)
    if not members_of.isEmpty():
        known = members_of.join(classes, ["set", "n"]).join(label, F.col("rep") == F.col("node"), "left").select("shingle", "set", "n", "p", F.coalesce("label", "rep", F.xxhash64("set", "n")).alias("label"))
        more = gathered(_across(known, t).select("a", "na", "b", "nb").distinct().join(tried, ["a", "na", "b", "nb"], "left_anti"))
        if not more.isEmpty():
            more = gathered(_likely(survey, more, t))
        if not more.isEmpty():
            links = gathered(links.unionByName(_verified(docs, more, classes, t, width)))
            label = _labels(links, classes)
    named = classes.join(label, F.col("rep") == F.col("node"), "left").select("set", "n", F.coalesce("label", "rep").alias("component"))
    out = members.select("doc_id", "set", "n", F.col("n").alias("n_shingles"))
    component = F.coalesce("component", "doc_id").alias("component_id")
    if not count:
        return out.join(named, ["set", "n"], "left").select("doc_id", "n_shingles", component)
    crowds = gathered(_crowds(members_of, links, classes, label, *tile))
    inside = [crowds.select(F.col("set").alias(a), F.col("n").alias(n), F.lit(True).alias(f"in_{a}")) for a, n in (("a", "na"), ("b", "nb"))]
    outside = links.join(inside[0], ["a", "na"], "left").join(inside[1], ["b", "nb"], "left").where("in_a IS NULL OR in_b IS NULL")  # the others are counted in their tiles
    ends = outside.select(F.explode(F.array(F.struct(F.col("a").alias("set"), F.col("na").alias("n")), F.struct(F.col("b").alias("set"), F.col("nb").alias("n")))).alias("e")).select("e.set", "e.n", F.lit(1).cast("bigint").alias("links"))
    if not crowds.isEmpty():
        ends = ends.unionByName(_within(docs, crowds, classes, t, width))
    degree = ends.groupBy("set", "n").agg(F.sum("links").alias("n_links_found"))
    out = out.join(named.join(degree, ["set", "n"], "left"), ["set", "n"], "left")
    return out.select("doc_id", "n_shingles", component, F.coalesce("n_links_found", F.lit(0)).cast("bigint").alias("n_links_found"))


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    ends = links.join(classes.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("rep").alias("u")), ["a", "na"])
    ends = ends.join(classes.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("rep").alias("v")), ["b", "nb"])
    return components(ends.select("u", "v"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays.

    Rows without doc_id all stay. Rows of one doc_id count as one document, in the component of the first of their texts
    (nulls first); of those that stay one remains, the first by text and then by its other columns as JSON. Other
    columns pass through under whatever name.
    """
    found = join(docs, count=False).groupBy("doc_id").agg(F.min("component_id").alias("__first")).where("doc_id = __first").select("doc_id")
    some = docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi")
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = some.groupBy("doc_id").agg(F.min_by(whole, F.struct(F.col("text"), rest)).alias("__row")) if docs.columns else some
    return one.select(*[F.col("__row")[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
