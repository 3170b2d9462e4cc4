"""URL filters: fixed rules first, else gradient-boosted trees on lexical features.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the
longest fitting rule wins. Where none fits, trees decide that were trained from labelled
URLs: length, depth, digit ratio, entropy, parameter counts and statistics of the host's
suffixes. Training takes at most about ``max_rows`` labelled URLs, chosen by hash (a
documented bound). Where rules make the labels, the share of blocked ones among them says nothing of other URLs, so both
labels weigh the same. Suffix statistics are smoothed rates in the sample. A suffix or path that it
lacks is marked as unseen; the trees learn what to do then from rows whose statistics are hidden at random.
Without labels of both kinds every URL gets the only or the default verdict (``allow``).

Defined results: a null URL or one without ``://`` has empty host and path; repeated rows
are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, as one CASE."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digits", "digit_ratio", "entropy", "params", "query_length", "fragment", "dashes", "dots", "longest_part", "suffix1", "suffix2", "first_part")


def lexical(url: str | None) -> tuple[list[float], tuple[str, str, str]]:
    """The numeric features, and the keys whose statistics complete them: last label, last two labels, first path part."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else url
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    tail, host = rest[len(host) :], host.translate(_LOWERED)
    path = re.split(r"[?#]", tail, maxsplit=1)[0]
    query = tail.split("#", 1)[0].partition("?")[2]
    parts, labels = [p for p in path.split("/") if p], host.split(".")
    digits, n = sum(c.isdigit() for c in url), len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    numbers = [n, len(host), len(path), len(parts), len(labels), digits, digits / max(n, 1), entropy, query.count("=") + query.count("&") if query else 0, len(query), float("#" in tail), url.count("-"), url.count("."), max(map(len, parts), default=0)]
    return [float(x) for x in numbers], (labels[-1], ".".join(labels[-2:]), parts[0] if parts else "")


UNSEEN = -1.0


class Boosted:
    """Gradient-boosted trees for log loss, over histograms of quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = self._binned(x)
        mean = min(max(np.average(y, weights=weight), 1e-6), 1 - 1e-6)
        self.base, self.trees = math.log(mean / (1 - mean)), []
        margin = np.full(n, self.base)
        nodes = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut, where = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(n, int)
            for level in range(self.depth):
                first, wide = (1 << level) - 1, 1 << level
                slot = where - first
                best, total = np.full(wide, 1e-6), (np.bincount(slot, g, wide), np.bincount(slot, h, wide))
                for f in range(width):
                    key = slot * self.bins + binned[:, f]
                    left_g, left_h = (np.cumsum(np.bincount(key, v, wide * self.bins).reshape(wide, self.bins), 1)[:, :-1] for v in (g, h))
                    right_g, right_h = total[0][:, None] - left_g, total[1][:, None] - left_h
                    gain = left_g**2 / (left_h + self.smooth) + right_g**2 / (right_h + self.smooth) - (total[0] ** 2 / (total[1] + self.smooth))[:, None]
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(wide), at] > best):
                        best[k], feature[first + k], cut[first + k] = gain[k, at[k]], f, at[k]
                where = self._down(binned, feature, cut, where)
            leaf = where - nodes
            value = self.rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + self.smooth)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    @staticmethod
    def _down(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, where: np.ndarray) -> np.ndarray:
        f = feature[where]
        right = (f >= 0) & (binned[np.arange(len(binned)), np.maximum(f, 0)] > cut[where])
        return 2 * where + 1 + right

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, margin = self._binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            where = np.zeros(len(x), int)
            for _ in range(self.depth):
                where = self._down(binned, feature, cut, where)
            margin += value[where - len(feature)]
        return 1 / (1 + np.exp(-margin))


@dataclass
class UrlModel:
    """Probability that a URL is to be blocked."""

    prior: float
    stats: list[dict[str, float]]
    trees: Boosted | None

    @classmethod
    def fit(cls, urls: list[str], labels: np.ndarray, weight: float = 20.0, **trees) -> UrlModel:
        labels = np.asarray(labels, float)
        prior = float(labels.mean()) if len(labels) else 0.0
        if not 0 < prior < 1:
            return cls(prior, [{}, {}, {}], None)
        even = np.where(labels > 0, 0.5 / prior, 0.5 / (1 - prior))
        made = [lexical(u) for u in urls]
        stats = []
        for k in range(3):
            times: Counter = Counter()
            seen: dict[str, float] = defaultdict(float)
            bad: dict[str, float] = defaultdict(float)
            for (_, keys), y, e in zip(made, labels, even, strict=True):
                times[keys[k]] += 1
                seen[keys[k]] += e
                bad[keys[k]] += e * y
            stats.append({key: (bad[key] + weight / 2) / (seen[key] + weight) for key, n in times.items() if n >= 5})
        model = cls(prior, stats, None)
        whole = model.features(urls)
        hidden = whole.copy()
        hidden[:, -3:][np.random.default_rng(10).random((len(urls), 3)) < 0.5] = UNSEEN
        model.trees = Boosted(**trees).fit(np.concatenate([whole, hidden]), np.tile(labels, 2), np.tile(even, 2))
        return model

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        for url in urls:
            numbers, keys = lexical(url)
            rows.append(numbers + [self.stats[k].get(key, UNSEEN) for k, key in enumerate(keys)])
        return np.array(rows, float).reshape(-1, len(FEATURES))

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.predict(self.features(urls)) if self.trees else np.full(len(urls), self.prior)


def sampled(labelled: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, by a hash of the URL."""
    n = labelled.count()
    return labelled if n <= max_rows else labelled.where(F.pmod(F.xxhash64("url", F.lit(11)), F.lit(1 << 20)) < (1 << 20) * max_rows // n)


def fit_urls(labelled: DataFrame, max_rows: int = 20_000) -> UrlModel:
    """``labelled``: url and label (1: block)."""
    rows = sampled(labelled, max_rows).select("url", "label").toPandas().sort_values(["url", "label"])
    return UrlModel.fit(rows["url"].tolist(), rows["label"].to_numpy())


def score_urls(pages: DataFrame, model: UrlModel, out: str = "block_score") -> DataFrame:
    """``pages`` with a column more: the probability that ``url`` is to be blocked."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(batch.column(batch.schema.get_field_index("url")).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, out])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in pages.dtypes) + f", {out} double"
    return arrow_map(pages, step, schema)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs under a rule are the labelled ones: its verdict is the label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES)
    judged = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": verdict})
    model = fit_urls(judged.where(F.col("verdict").isNotNull()).select("url", (F.col("verdict") == "block").cast("int").alias("label")))
    scored = score_urls(judged, model)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
