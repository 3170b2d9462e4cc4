"""Language-model scoring with an Elias-Fano n-gram trie.

An interpolated trigram model: ``p(w | uv) = (1 - l(uv)) * c(uvw) / c(uv) + l(uv) * p(w | v)``,
``p(w | v) = (1 - l(v)) * c(vw) / c(v) + l(v) * p1(w)``, with Witten and Bell's
``l(h) = k * n(h) / (c(h) + k * n(h))``, where n(h) counts the distinct words after h, and
``p1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))``; unseen words share what p1 leaves. Texts are words
(A-Z lower-cased) and one end, after one begin; a text's first token has no trigram.

Documents are packed into blocks. A block sends each distinct word, bigram and trigram
it holds once, with its training counts, to the shard of the first word; so a frequent
one costs a block one entry. A shard sums the counts as it reads them, builds its trie (contexts,
pointers and context-relative successors as Elias-Fano levels in memory-mapped files, with
``c(hw) / c(h)`` and ``l(h)`` quantised to a byte) and answers every block from it. Blocks then
score their documents. Contexts that hold over ``hot_share`` of all tokens (at most its
inverse) are sliced over many shards by successor; their n(h) is summed over the slices. The number of shards grows with the tokens, so a
shard's memory is bounded; a word's successors are known by 40 bits of their hash in their
context (two of a million are mistaken for each other with probability 1e-6), a bigram's by 32.

Defined results: a null text is an empty one (only the end); without training documents
every word is unknown and counts are 0; repeated rows are scored, and train, one by one.
"""

from __future__ import annotations

import io
import math
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut, cut_and_clean, fold, parts, table, tidy
from .elias_fano import Trie

BEGIN, END = np.uint64(0x0B), np.uint64(0x0E)
SLICES = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Codes 1..255 stand for log10 values from 0 down to -12; 0 for none.
STEP = 12 / 254
_VALUES = np.concatenate([[0.0], 10 ** (-STEP * np.arange(255))])


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 254), 0).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed."""
    out = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def _load(data: bytes) -> list[np.ndarray]:
    file, out = io.BytesIO(zstandard.ZstdDecompressor().decompress(data)), []
    while file.tell() < len(file.getbuffer()):
        out.append(np.lib.format.read_array(file, allow_pickle=False))
    return out


def _planes(values: np.ndarray, n: int) -> np.ndarray:
    """The lower ``n`` bytes of each value, byte by byte: upper bytes of small numbers repeat and compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T


def _whole(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : planes.shape[0]] = planes.T
    return out.view("<u8").ravel()


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in a row (as ``words_of`` has them), and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    there = np.asarray(pc.binary_length(flat)) > 0
    upto = np.append(0, np.cumsum(there))
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    return flat.filter(pa.array(there)), upto[offsets[1:]] - upto[offsets[:-1]]


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, and which of them each word is."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)), np.asarray(coded.indices)


class Block:
    """The words, bigrams and trigrams of some texts, laid out by shard."""

    def __init__(self, texts: pa.Array, train: np.ndarray, hot: np.ndarray, shards: int, order: int):
        flat, sizes = _words(texts)
        hashes, index = _hashed(flat)
        words = np.unique(np.concatenate([[BEGIN, END], hashes]))
        self.sizes = sizes + 1
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        token_at = np.full(int(self.ends[-1]), np.searchsorted(words, END))
        inside = np.ones(len(token_at), bool)
        inside[self.ends - 1] = False
        token_at[inside] = np.searchsorted(words, hashes)[index]
        begin = int(np.searchsorted(words, BEGIN))
        own = np.repeat(train, self.sizes)
        counts = np.bincount(token_at, own, len(words)).astype(np.int64)
        counts[begin] += int(train.sum())
        before_at = np.empty(len(token_at), np.int64)
        before_at[1:] = token_at[:-1]
        before_at[self.starts] = begin
        pair, pair_of = np.unique(before_at * len(words) + token_at, return_inverse=True)
        times = np.bincount(pair_of, own, len(pair)).astype(np.int64)
        head, tail = pair // len(words), pair % len(words)
        mixed = _mixed(words)
        successor = mixed >> np.uint64(24)
        is_hot = np.isin(words, hot)
        entry_word = np.concatenate([np.flatnonzero(~is_hot), np.repeat(np.flatnonzero(is_hot), SLICES)])
        entry_slice = np.concatenate([np.zeros(int((~is_hot).sum()), np.int64), np.tile(np.arange(SLICES), int(is_hot.sum()))])
        with np.errstate(over="ignore"):
            key = words[entry_word] + entry_slice.astype(np.uint64) * _MIX  # a slice of a context is a context of its own
        shard = (_mixed(key) % np.uint64(shards)).astype(np.int64)
        placed = np.lexsort((key, shard))
        self.key, self.shard, entry_word, entry_slice = key[placed], shard[placed], entry_word[placed], entry_slice[placed]
        self.count = counts[entry_word]
        self.hot_at = np.where(is_hot[entry_word], np.searchsorted(hot, words[entry_word]), -1)
        place = np.full(len(words), -1)
        first = entry_slice == 0
        place[entry_word[first]] = np.flatnonzero(first)
        sliced = np.full((int(is_hot.sum()), SLICES), -1)
        hot_row = np.cumsum(is_hot) - 1
        of_hot = is_hot[entry_word]
        sliced[hot_row[entry_word[of_hot]], entry_slice[of_hot]] = np.flatnonzero(of_hot)
        entry = place[head]
        hot_pair = is_hot[head]
        entry[hot_pair] = sliced[hot_row[head[hot_pair]], (successor[tail[hot_pair]] % np.uint64(SLICES)).astype(np.int64)]
        placed = np.lexsort((successor[tail], entry))
        self.successor, self.pair_entry, self.tail, self.times = successor, entry[placed], tail[placed], times[placed]
        back = np.empty(len(placed), np.int64)
        back[placed] = np.arange(len(placed))
        self.pair_of = back[pair_of]
        self.entry_of = place[token_at]
        self.begins = np.append(np.flatnonzero(np.append(True, self.shard[1:] != self.shard[:-1])), len(self.shard))
        # a trigram lies below the bigram before its last word; a text's first token has none
        self.later = np.ones(len(token_at), bool)
        self.later[self.starts] = False
        if order < 3:
            self.later[:] = False
        at = np.flatnonzero(self.later)
        triple, self.triple_of = np.unique(self.pair_of[at - 1] << 32 | token_at[at], return_inverse=True)
        self.triple_times = np.bincount(self.triple_of, own[at], len(triple)).astype(np.int64)
        self.triple_pair, self.last = triple >> 32, triple & 0xFFFFFFFF

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """(shard, what it is asked and told)."""
        pairs = np.searchsorted(self.pair_entry, self.begins)
        triples = np.searchsorted(self.triple_pair, pairs)
        number = np.empty(len(self.successor), np.int64)
        for k in range(len(self.begins) - 1):
            (a, b), (x, y), (s, t) = self.begins[k : k + 2], pairs[k : k + 2], triples[k : k + 2]
            per = np.bincount(self.pair_entry[x:y] - a, minlength=b - a)
            below = np.bincount(self.triple_pair[s:t] - x, minlength=y - x)
            said = np.append(self.tail[x:y], self.last[s:t])
            number[said[::-1]] = np.arange(len(said), 0, -1)
            first = number[said] == np.arange(1, len(said) + 1)
            used = said[first]  # words in order of appearance: 0 stands for the next one, k for the k-th
            number[used] = np.arange(1, len(used) + 1)
            said = np.where(first, 0, number[said])
            told = (self.count[a:b], per, self.times[x:y], below, self.triple_times[s:t])
            keys = np.diff(self.key[a:b], prepend=np.uint64(0))
            yield int(self.shard[a]), _dump(_planes(keys, 8), _planes(self.successor[used], 5), _planes(said, 4), *(z.astype(np.uint32) for z in told))

    def score(self, answers: list[tuple[int, bytes]], total: int, distinct: int, after: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text. ``answers`` by shard; ``after``: n(h) of the frequent words."""
        parts_ = [_load(x) for _, x in sorted(answers)]
        count, weight, code, lower, triple = (np.concatenate([p[k] for p in parts_]) for k in range(5))
        c = count[self.entry_of].astype(float)
        base = (c + 0.5) / (total + 0.5 * (distinct + 1))
        backed, often = _VALUES[weight], self.hot_at >= 0
        n = k * after[self.hot_at[often]]
        backed[often] = n / np.maximum(count[often] + n, 1e-9)
        backed[count == 0] = 1.0
        pair = self.pair_of
        left = backed[self.pair_entry[pair]]
        p = (1 - left) * _VALUES[code[pair]] + left * base
        at = np.flatnonzero(self.later)
        if len(at):
            left = np.where(lower > 0, _VALUES[lower], 1.0)[pair[at - 1]]
            p[at] = (1 - left) * _VALUES[triple[self.triple_of]] + left * p[at]
        add = lambda x: np.add.reduceat(x, self.starts)
        return add((c > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(np.minimum(p, 1.0)))


class Request:
    """What a block asks and tells a shard: words, for each its successors, for each of those its own."""

    def __init__(self, data: bytes):
        keys, words, said, self.count, self.per, self.times, self.below, self.triple_times = _load(data)
        self.key, said = np.cumsum(_whole(keys), dtype=np.uint64), _whole(said).astype(np.int64)
        first = said == 0
        said -= 1
        said[first] = np.arange(words.shape[1])
        words = _whole(words)[said]
        self.tail, self.last = words[: len(self.times)], words[len(self.times) :] >> np.uint64(8)

    def pairs(self, rank: np.ndarray) -> np.ndarray:
        """Successors with the base of their contexts, whose ranks are given."""
        return np.repeat(rank.astype(np.uint64) << np.uint64(40), self.per) | self.tail


def _summed(pieces: Iterable[tuple[np.ndarray, np.ndarray]], room: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers. What waits to be summed stays within the distinct keys and ``room``."""
    keys, numbers, waiting = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0

    def settle() -> None:
        nonlocal waiting
        key, number = np.concatenate(keys), np.concatenate(numbers)
        order = np.argsort(key, kind="stable")  # runs that are in order already merge fast
        key, number = key[order], number[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        keys[:], numbers[:], waiting = [key[new]], [np.add.reduceat(number, new) if len(new) else number], 0

    for key, number in pieces:
        keys.append(key)
        numbers.append(number.astype(np.int64))
        waiting += len(key)
        if waiting > room + len(keys[0]):
            settle()
    settle()
    return keys[0], numbers[0]


def build_trie(requests: Callable[[], Iterable[bytes]], k: float) -> Trie:
    """The trie of all training counts in a shard's requests, which are read once a level."""

    def contexts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for data in requests():
            told = Request(data)
            yield told.key, told.count

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for data in requests():
            told = Request(data)
            seen = told.times > 0
            yield told.pairs(np.searchsorted(keys, told.key))[seen], told.times[seen]

    def triples() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for data in requests():
            told = Request(data)
            seen = told.triple_times > 0  # then the bigram is one of training as well
            owner = np.searchsorted(placed, told.pairs(np.searchsorted(keys, told.key)))
            yield (np.repeat(owner.astype(np.uint64) << np.uint64(32), told.below) | told.last)[seen], told.triple_times[seen]

    keys, counts = _summed(contexts())
    placed, together = _summed(pairs())
    lower, thrice = _summed(triples())

    def level(based: np.ndarray, number: np.ndarray, bits: int, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        owner = (based >> np.uint64(bits)).astype(np.int64)
        different = k * np.bincount(owner, minlength=len(above))
        return based, quantised(number / above[owner]), quantised(different / np.maximum(above + different, 1e-9)), 1 << bits

    return Trie(keys, counts, [level(placed, together, 40, counts), level(lower, thrice, 32, together)])


def answer(trie: Trie, request: bytes) -> bytes:
    """Counts and weights of the words asked for, codes and weights of their successors, codes of those' successors."""
    asked = Request(request)
    rank, _ = trie.context(asked.key)
    second, third = trie.levels
    at, found = second.places(np.repeat(rank, asked.per), asked.tail)
    weights = np.zeros(len(at), np.uint8)
    weights[found] = third.weights[at[found]]
    codes = np.zeros(len(asked.last), np.uint8)
    known = np.repeat(found, asked.below)
    codes[known] = third.code(*third.places(np.repeat(at, asked.below)[known], asked.last[known]))
    return _dump(np.asarray(trie.counts[rank]).astype(np.uint32), np.asarray(second.weights[rank]), second.code(at, found), weights, codes)


def _packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, tokens, train_tokens, train_docs, frequent, data): documents in compressed blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column(2)).fill_null(0))
            train = np.asarray(batch.column(1).fill_null(False))
            cuts, size = [0], 0
            for k, length in enumerate(lengths.tolist()):
                size += length + 8
                if size >= block_bytes or k == len(lengths) - 1:
                    cuts.append(k + 1)
                    size = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                flat, sizes = _words(part.column(2))
                sizes += 1
                value, index = _hashed(flat)
                count = np.bincount(index, minlength=len(value))
                often = count >= max(50, len(flat) / 4000)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [number],
                        "tokens": [int(sizes.sum())],
                        "train_tokens": [int(sizes[train[a:b]].sum())],
                        "docs": [b - a],
                        "frequent": [[{"word": int(v), "n": int(c)} for v, c in zip(value[often].astype(np.int64), count[often], strict=True)]],
                        "data": [zstandard.ZstdCompressor(level=3).compress(sink.getvalue())],
                    },
                    pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("train_tokens", pa.int64()), ("docs", pa.int64()), ("frequent", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))), ("data", pa.binary())]),
                )
                number += 1

    ship(docs.sparkSession)
    return docs.mapInArrow(tidy(run), "block bigint, tokens bigint, train_tokens bigint, docs bigint, frequent array<struct<word:bigint,n:bigint>>, data binary")


def _unpacked(data: bytes) -> pa.RecordBatch:
    table_ = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
    return table_.combine_chunks().to_batches()[0]


_ANSWER = "kind int, block bigint, shard int, words bigint, data binary"


def score_lm(docs: DataFrame, held_out: Column, k: float = 4.0, block_bytes: int = 8 << 20, shard_tokens: int = 4_000_000, hot_share: float = 0.0005, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. Rows for which ``held_out`` holds do not train. ``order``: 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", (~held_out).alias("train"), "text")
    kind = rows.dtypes[0][1]
    blocks = cut(_packed(rows, block_bytes))
    tokens, total = (int(x or 0) for x in blocks.agg(F.sum("tokens"), F.sum("train_tokens")).first())
    frequent = blocks.select(F.explode("frequent").alias("f")).groupBy("f.word").agg(F.sum("f.n").alias("n")).where(F.col("n") >= max(1.0, hot_share * tokens)).select("word").collect()
    hot = np.sort(np.array([int(BEGIN), *(r["word"] for r in frequent)], np.int64).astype(np.uint64))
    shards = max(parts(spark), math.ceil(tokens / shard_tokens))

    with np.errstate(over="ignore"):
        slices = hot[:, None] + np.arange(SLICES, dtype=np.uint64) * _MIX

    def block_of(batch: pa.RecordBatch) -> Block:
        return Block(batch.column(2), np.asarray(batch.column(1).fill_null(False)), hot, shards, order)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sent = list(block_of(_unpacked(data.as_py())).requests())
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(sent), pa.int64()), pa.array([s for s, _ in sent], pa.int32()), pa.array([d for _, d in sent], pa.binary())], ["block", "shard", "data"])

    def serve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, waiting, shard = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            def stored() -> Iterator[tuple[int, bytes]]:
                spool.seek(0)
                for block, size in waiting:
                    yield block, spool.read(size)

            trie = build_trie(lambda: (d for _, d in stored()), k)
            words = int(((trie.counts[:] > 0) & first_slice(trie)).sum())
            ranges = trie.levels[0].pointers.get(np.arange(trie.contexts.n + 1)).astype(np.int64)
            rank, there = trie.context(slices.ravel())
            for word, at in zip(np.repeat(hot.astype(np.int64), SLICES)[there].tolist(), rank[there].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([word], pa.int64()), pa.array([shard], pa.int32()), pa.array([int(ranges[at + 1] - ranges[at])], pa.int64()), pa.array([None], pa.binary())], ["kind", "block", "shard", "words", "data"])
            for nth, (block, data) in enumerate(stored()):
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([0 if nth else words], pa.int64()), pa.array([answer(trie, data)], pa.binary())], ["kind", "block", "shard", "words", "data"])
            spool.close()

        def first_slice(trie: Trie) -> np.ndarray:
            """Contexts that are words: not begin, nor a further slice of a frequent one."""
            return ~np.isin(trie.contexts.get(np.arange(trie.contexts.n)), np.append(slices[:, 1:].ravel(), BEGIN))

        for batch in batches:
            for block, s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != shard:
                    if shard is not None:
                        yield from close()
                    handle, path = tempfile.mkstemp()
                    os.unlink(path)
                    spool, waiting, shard = os.fdopen(handle, "w+b"), [], s
                data = data.as_py()
                spool.write(data)
                waiting.append((block, len(data)))
        if shard is not None:
            yield from close()

    asked = blocks.select("block", "data").mapInArrow(tidy(ask), "block bigint, shard int, data binary").repartitionById(shards, "shard").sortWithinPartitions("shard", "block")
    answers = cut_and_clean(spark, lambda: asked.mapInArrow(tidy(serve), _ANSWER))
    distinct = int(answers.where("kind = 1").agg(F.sum("words")).first()[0] or 0)
    summed = {r["block"]: r["n"] for r in answers.where("kind = 2").groupBy("block").agg(F.sum("words").alias("n")).collect()}
    after = np.array([summed.get(int(h), 0) for h in hot.astype(np.int64)], float)
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, got, current = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            block = block_of(documents)
            known, base, scores = block.score(got, total, distinct, after, k)
            n = len(scores)
            train = documents.column(1).fill_null(False)
            yield pa.RecordBatch.from_arrays([documents.column(0), pc.invert(train), pa.array(block.sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(base), pa.array(scores)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for what, block, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if block != current:
                    if current is not None:
                        yield from close()
                    current, got, documents = block, [], None
                if what:
                    got.append((shard, data.as_py()))
                else:
                    documents = _unpacked(data.as_py())
        if current is not None:
            yield from close()

    whole = blocks.select(F.lit(0).alias("kind"), "block", F.lit(-1).alias("shard"), "data").unionByName(answers.where("kind = 1").select("kind", "block", "shard", "data"))
    return whole.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(tidy(finish), out)


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_lm(docs, fold(F.col("doc_id")) == 1)
