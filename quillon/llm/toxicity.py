"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts count as unlabelled. A linear
model over hashed words is trained with numpy on the risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` of the sigmoid loss; where the bracket
goes negative it counts as 0 and has no gradient, so the model does not fit unlabelled texts
as negatives beyond what the class prior allows.

The class prior is the toxic share among labelled training rows. Training takes at most
about ``max_positive`` and ``max_unlabelled`` texts, chosen by hash (documented bounds), and at most
``max_features`` features. Spark counts the sample's features and chooses those that positives have
clearly more often; the driver gets only each text's numbers of chosen features. Scoring is narrow and
reads whole texts.

Defined results: null and empty texts get the score of no words; with no positives every
score is the prior (0 without labels); repeated rows are scored one by one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, binaries, cut, fold, release, table, words_of

EDGES = b".,;:!?|*$%&#\"'()[]<>"


def features(text: bytes | None) -> set[bytes]:
    """A text's distinct words without marks at their edges, and the beginnings of the longer ones."""
    words = {w.strip(EDGES) for w in set(words_of(text))} - {b""}
    return {b"=" + w for w in words} | {b"4" + w[:4] for w in words if len(w) > 4} | {b"6" + w[:6] for w in words if len(w) > 6}


def hashed(text: bytes | None) -> np.ndarray:
    found = features(text)
    return np.fromiter((zlib.crc32(x) for x in found), np.uint32, len(found))


@dataclass
class PuModel:
    """Weights of the few features that training has selected."""

    words: dict[bytes, float]
    short: dict[bytes, float]
    long: dict[bytes, float]
    bias: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            if text and (self.words or self.short or self.long):
                words = {w.strip(EDGES) for w in set(words_of(text))}
                margin[k] += sum(map(self.words.get, words & self.words.keys()))
                margin[k] += sum(map(self.short.get, {w[:4] for w in words if len(w) > 4} & self.short.keys()))
                margin[k] += sum(map(self.long.get, {w[:6] for w in words if len(w) > 6} & self.long.keys()))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in rows], int)
    return np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)


def fit_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, width: int, steps: int = 600, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk over all texts, each a list of features under ``width``; returns weights and bias where the risk was least."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.zeros(width), bias if positive or unlabelled else -500.0
    (fp, op), (fu, ou) = _rows(positive), _rows(unlabelled)
    n, many = len(positive), len(unlabelled)
    w, m, v = np.zeros(width), np.zeros(width + 1), np.zeros(width + 1)
    best = (np.inf, w, bias)
    for step in range(1, steps + 1):
        zp, zu = bias + np.bincount(op, w[fp], n), bias + np.bincount(ou, w[fu], many)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -500, 500))), 1 / (1 + np.exp(-np.clip(zu, -500, 500)))
        bracket, slope_p, slope_u = su.mean() - prior * sp.mean(), sp * (1 - sp), su * (1 - su)
        risk = prior * (1 - sp).mean() + max(0.0, bracket) + decay / 2 * (w @ w)
        if risk < best[0]:
            best = (risk, w.copy(), bias)
        if bracket >= 0:
            gp, gu = -2 * prior * slope_p / n, slope_u / many
        else:
            gp, gu = -prior * slope_p / n, np.zeros(many)
        g = np.append(np.bincount(fp, gp[op], width) + np.bincount(fu, gu[ou], width) + decay * w, gp.sum() + gu.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:width]
        bias -= float(move[width])
    return best[1], best[2]


def _bounded(rows: DataFrame, most: int, salt: int) -> DataFrame:
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) < (1 << 20) * most // n)


def _side(docs: DataFrame, positive: bool) -> DataFrame:
    """(positive, mark, features): each text's distinct feature hashes, packed, and a hash of them all by which texts are put in order."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.sort(hashed(x)).tobytes() for x in binaries(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array([positive] * len(made)), pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in made], pa.int64()), pa.array(made, pa.binary())], ["positive", "mark", "features"])

    return arrow_map(docs.select("text"), step, "positive boolean, mark bigint, features binary")


def _selected(texts: DataFrame, n: int, many: int, least: float, min_rows: int, max_features: int) -> np.ndarray:
    """Hashes, in order, of the features that positives have more often than unlabelled texts by ``least`` standard errors (of more than ``max_features`` those with the most). Counted and chosen in Spark."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        positive, out = np.asarray(batch.column(0)), []
        for side in (True, False):
            rows = [np.frombuffer(x, np.uint32) for x, p in zip(batch.column(1).to_pylist(), positive, strict=True) if p == side]
            value, count = np.unique(np.concatenate([*rows, np.empty(0, np.uint32)]), return_counts=True)
            zero = np.zeros_like(count)
            out.append((value.astype(np.int64), *((count, zero) if side else (zero, count))))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["feature", "p", "u"])

    counts = arrow_map(texts.select("positive", "features"), step, "feature bigint, p bigint, u bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = (F.col("p") + F.col("u") + 1) / (n + many + 2)
    more = (F.col("p") / n - F.col("u") / many) / F.sqrt(rate * (1 - rate) * (1 / n + 1 / many))
    chosen = counts.where(F.col("p") >= min_rows).withColumn("more", more).where(F.col("more") >= least).orderBy(F.desc("more"), "feature").limit(max_features)

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(0)).astype(np.uint32).tobytes()], pa.binary())], ["features"])

    found = [np.frombuffer(bytes(r["features"]), np.uint32) for r in arrow_map(chosen.select("feature"), packed, "features binary").collect()]
    return np.sort(np.concatenate([*found, np.empty(0, np.uint32)]))


def _narrowed(texts: DataFrame, kept: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The positives' and the others' places in ``kept``, texts in the order of their marks. Only these few numbers of the bounded sample reach the driver."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in batch.column(2).to_pylist():
            own = np.frombuffer(x, np.uint32)
            at = np.minimum(np.searchsorted(kept, own), max(len(kept) - 1, 0))
            out.append((at[kept[at] == own] if len(kept) else at[:0]).astype(np.uint32))
        sizes = np.array(list(map(len, out)), np.uint32)
        made = np.asarray(batch.column(0)).tobytes() + np.asarray(batch.column(1)).tobytes() + sizes.tobytes() + np.concatenate(out).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([len(out)], pa.int64()), pa.array([made], pa.binary())], ["n", "data"])

    sides: tuple[list, list] = ([], [])
    for r in arrow_map(texts, step, "n bigint, data binary").collect():
        n, data = r["n"], bytes(r["data"])
        positive, mark, sizes = np.frombuffer(data, bool, n), np.frombuffer(data, np.int64, n, n), np.frombuffer(data, np.uint32, n, 9 * n)
        rows = np.split(np.frombuffer(data, np.uint32, -1, 13 * n), np.cumsum(sizes)[:-1])
        for k in range(n):
            sides[0 if positive[k] else 1].append((int(mark[k]), rows[k].tobytes()))
    return tuple([np.frombuffer(x, np.uint32) for _, x in sorted(side)] for side in sides)


def _names(docs: DataFrame, kept: np.ndarray) -> set[bytes]:
    """The features behind the hashes in ``kept``; of the positives, so there are about as many as hashes."""
    wanted = set(kept.tolist())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {x for text in binaries(batch.column(0)) for x in features(text) if zlib.crc32(x) in wanted}
        return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["name"])

    return {bytes(r["name"]) for r in arrow_map(docs.select("text"), step, "name binary").distinct().collect()}


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_positive: int = 4_000, max_unlabelled: int = 12_000, max_features: int = 1 << 16, least: float = 4.0, min_rows: int = 2, **how) -> PuModel:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. Rows for which ``held_out`` holds give no labels and no texts."""
    of = ~held_out if held_out is not None else F.lit(True)
    docs = docs.select("doc_id", "text").where(of)
    known = labels.select("doc_id", "toxic").where(of & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = _bounded(known.where(F.col("toxic") == 1), max_positive, 1).select("doc_id")
    confirmed = docs.join(F.broadcast(chosen), "doc_id", "left_semi")
    texts = cut(_side(confirmed, True).unionByName(_side(_bounded(docs, max_unlabelled, 2), False)))
    sizes = {r["positive"]: r["n"] for r in texts.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    prior, both = toxic / n if n else 0.0, sizes.get(True, 0) and sizes.get(False, 0)
    kept = _selected(texts, sizes[True], sizes[False], least, min_rows, max_features) if both else np.empty(0, np.uint32)
    positive, others = _narrowed(texts, kept) if both else ([np.empty(0, np.uint32)] * sizes.get(k, 0) for k in (True, False))
    weights, bias = fit_pu(positive, others, prior, len(kept), **how)
    value = dict(zip(kept.tolist(), weights.tolist(), strict=True))
    named = {x: value[zlib.crc32(x)] for x in sorted(_names(confirmed, kept))} if len(kept) else {}
    release()
    return PuModel(*({x[1:]: w for x, w in named.items() if x[:1] == kind} for kind in (b"=", b"4", b"6")), bias)


def score(docs: DataFrame, model: PuModel) -> DataFrame:
    """doc_id and score of every row of ``docs``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(binaries(batch.column(1))))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return arrow_map(rows, step, f"doc_id {rows.dtypes[0][1]}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id")) == 0
    model = train(docs, table(spark, sf_dir, "labels"), held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is 0.5 or more go. The model is trained on the stage's own documents.

    Rows are judged one by one by their text: null ids (which no label names), repeated ids and equal rows don't
    matter, and other columns pass through under whatever name. A tie at 0.5 goes.
    """
    model = train(docs, table(spark, sf_dir, "labels"))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index("text"))
        return batch.filter(pa.array(model.score(binaries(text)) < 0.5))

    return arrow_map(docs, keep, docs.schema)
