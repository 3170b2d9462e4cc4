"""Packing along a space-filling curve.

Each document's token ids (and id 0 at its end) are hashed into a vector, projected to a
few dimensions, and placed on a Hilbert curve. Documents are range-sorted by their key, so
that neighbours are alike, and packed in that order.

A document's whole runs of ``length`` ids are sequences by themselves; what is left of it
travels with the key, and the left-overs of a range are joined along the curve and cut
every ``length`` ids. Only the last sequence of a range is padded. There is one shuffle, of
the left-overs (16-bit ids where they fit).

Defined results: a null text is an empty one and becomes its end id alone; repeated rows
are packed one by one; an empty table gives no rows. ``sequence_id`` holds the range in
its upper bits and is unique, not gapless.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import arrow_map, cut, table, tidy


@lru_cache(2)
def encoder(path: str):
    """texts -> lists of ids, as the ``tokenizers`` library gives them. For a byte-level BPE file whose ids follow its merges the same ids come from ``tiktoken``, which is about four times as fast; a text that it can't split goes to the library."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre, special = spec["model"], spec.get("pre_tokenizer") or {}, {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges")
    plain = plain and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec.get("added_tokens", []))
    by_id = sorted((k, t) for t, k in model["vocab"].items() if t not in special) if plain else []
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]] if plain else []
    if not plain or [t for _, t in by_id[256:]] != merged or [k for k, _ in by_id] != list(range(len(by_id))):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda texts: [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes(byte[c] for c in t): k for k, t in by_id}, special_tokens=special)
    rest: list = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # its splitter gives up on very long runs of white space
            if not rest:
                from tokenizers import Tokenizer

                rest.append(Tokenizer.from_file(path))
            return rest[0].encode(text, add_special_tokens=False).ids

    return lambda texts: [encode(x) for x in texts]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer points (a row each, every coordinate under 2**bits) on the Hilbert curve, by Gray-code transposition."""
    x = points.T.astype(np.uint64)
    n = len(x)
    one = np.uint64(1)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = np.uint64(bit - 1)
        for i in range(n):
            high = (x[i] & np.uint64(bit)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & np.uint64(bit)) != 0, np.uint64(bit - 1), np.uint64(0))
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _projection(buckets: int, dims: int) -> np.ndarray:
    return np.random.default_rng(9).choice([-1.0, 1.0], (buckets, dims))


def curve_keys(ids: np.ndarray, ends: np.ndarray, buckets: int = 1024, dims: int = 4, bits: int = 12) -> np.ndarray:
    """Hilbert keys of documents whose ids lie one after the other, each up to its ``ends``."""
    starts = np.append(0, ends[:-1])
    place = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    rows = _projection(buckets, dims)[place.astype(np.intp) % buckets]
    sums = np.add.reduceat(rows, starts, axis=0)
    spread = sums / np.sqrt(np.maximum(ends - starts, 1))[:, None]
    unit = 1 / (1 + np.exp(-spread / 2))
    return hilbert(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, carry: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` is binary, little-endian unsigned 32-bit; with ``carry="ids_crc32"`` a column of that name
    holds their crc32 instead, and whole runs don't have to travel.
    """
    rows = docs.select(docs[f"`{id_col}`"], F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))
    kind = rows.schema[0].dataType

    as_ids = carry == "ids"

    def carried(block: np.ndarray) -> bytes | int:
        plain = block.astype("<u4").tobytes()
        return plain if as_ids else zlib.crc32(plain)

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, owners = batch.column(1).to_pylist(), batch.column(0)
        at, whole, rest, totals, keys = [], [], [], [], []
        for a in range(0, len(texts), 500):
            lists = [np.array([*x, end_id], np.uint32) for x in encoder(path)(texts[a : a + 500])]
            ends = np.cumsum([len(x) for x in lists])
            keys.append(curve_keys(np.concatenate(lists), ends))
            for x in lists:
                n = len(x) // length
                whole.append([carried(x[k * length : (k + 1) * length]) for k in range(n)])
                left = x[n * length :]
                rest.append(left.astype("<u2" if len(left) and left.max() < 65536 else "<u4").tobytes())
                at.append(len(left))
                totals.append(len(x))
        return pa.RecordBatch.from_arrays([owners, pa.array(np.concatenate(keys)), pa.array(totals, pa.int64()), pa.array(whole, pa.list_(pa.binary() if as_ids else pa.int64())), pa.array(at, pa.int32()), pa.array(rest, pa.binary())], ["id", "key", "tokens", "whole", "n_rest", "rest"])

    left = cut(arrow_map(rows, cut_up, f"id {kind.simpleString()}, key bigint, tokens bigint, whole array<{'binary' if as_ids else 'bigint'}>, n_rest int, rest binary"))  # the range partitioning reads it twice
    ranged = left.repartitionByRange("key", F.xxhash64("id")).sortWithinPartitions("key", "id")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "*")
    out = StructType([StructField(id_col, kind)] + [StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), (carry, T.BinaryType() if as_ids else T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])

    def along(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled, alone = 0, 0, 0
        for batch in batches:
            pieces: list[tuple] = []
            for row in batch.to_pylist():
                base = row["part"] << 33
                for k, c in enumerate(row["whole"]):  # odd ids: sequences of one document; even ones: joined
                    pieces.append((row["id"], k * length, length, c, row["tokens"], base + 2 * alone + 1, 0))
                    alone += 1
                n, at = row["n_rest"], 0
                ids = np.frombuffer(row["rest"], "<u2" if len(row["rest"]) == 2 * n else "<u4")
                while at < n:
                    take = min(n - at, length - filled)
                    pieces.append((row["id"], row["tokens"] - n + at, take, carried(ids[at : at + take]), row["tokens"], base + 2 * sequence, filled))
                    at, filled = at + take, filled + take
                    if filled == length:
                        sequence, filled = sequence + 1, 0
            if pieces:
                columns = list(zip(*pieces, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("id").type), *(pa.array(c, pa.binary() if as_ids and k == 2 else pa.int64()) for k, c in enumerate(columns[1:]))], [f.name for f in out])

    return ranged.mapInArrow(tidy(along), out)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), carry="ids_crc32")
