"""Quality rules as a learned decision list, with SQL functions only.

Statistics of each whole text are columns. Sequential covering grows one rule at a time
from labelled rows: starting from all uncovered rows it adds the threshold condition with
the best gain of information (FOIL) until the rule is pure or ``max_conditions`` long, prunes
conditions that a pruning share of the labelled rows does not support, keeps the rule if
it is precise enough on that share, and removes the rows it covers. Every step reads one grouped histogram (features
x bins x label) of the rows still in play, so the driver sees a bounded number of counts.
The list becomes one ordered CASE: the first rule that fires decides, and else the
document is kept.

Learning takes at most about ``max_rows`` labelled rows, chosen by hash (a documented
bound). Only rows whose label is 0 or 1 teach. Defined results: null texts have no words
and fail the base rule; with no labelled rejects the list is empty; repeated rows are
judged one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(hashes: Column) -> Column:
    """A hash for each run of eight words, from theirs: pairs, then pairs of pairs, then pairs of those."""

    def paired(hashes: Column, step: int) -> Column:
        return _let(hashes, lambda h: F.when(F.size(h) > step, F.zip_with(F.slice(h, 1, F.size(h) - step), F.slice(h, 1 + step, F.size(h) - step), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))

    return paired(paired(paired(hashes, 1), 2), 4)


def _repeated(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more. Only texts that have one are sorted."""

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def twins(s: Column) -> Column:
            near = lambda x, i, d: F.get(s, i + F.lit(d))["h"] == x["h"]
            return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(near(x, i, -1), F.lit(False)) | F.coalesce(near(x, i, 1), F.lit(False))), lambda x: x["at"]))

        def width(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b)

        return _let(placed, lambda s: _let(twins(s), width))

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


#: What rules may ask about, as SQL over the base statistics and cheap counts.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_chars, 1)",
    "upper_rate": "n_upper / greatest(n_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, out: str = "stats") -> DataFrame:
    """``docs`` with the statistics of ``text`` in a struct ``out``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    body = lambda w, h, ls: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
        _repeated(_windows(h)).cast("bigint").alias("n_repeat_words"),
        F.length(text).cast("bigint").alias("n_chars"),
        F.size(ls).cast("bigint").alias("n_lines"),
        F.size(F.array_distinct(h)).cast("bigint").alias("n_distinct"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_upper"),
    )
    return docs.withColumn(out, _let(words, lambda w: _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(lines, lambda ls: body(w, h, ls)))))


def base_failed(stats: str = "stats") -> Column:
    return F.expr(f"{stats}.n_words < 20 OR 100 * {stats}.n_repeat_words > 30 * {stats}.n_words")


def measured(stats: str = "stats") -> dict[str, Column]:
    names = ("n_words", "word_chars", "n_symbols", "n_chars", "n_upper", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct")
    out = {}
    for name, sql in FEATURES.items():
        for n in names:
            sql = sql.replace(f" {n},", f" {stats}.{n},").replace(f"({n},", f"({stats}.{n},")
        head = sql.split(" ")[0]
        out[name] = F.expr(f"CAST({stats}.{head}{sql[len(head):]} AS double)")
    return out


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def fires(rule: Rule, of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column(of)
    return out


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    found = rows.agg(*[F.percentile_approx(f, [k / bins for k in range(1, bins)], 1000).alias(f) for f in FEATURES], *[F.min(f).alias(f"min_{f}") for f in FEATURES]).first()
    return {f: sorted({*(found[f] or ()), *([found[f"min_{f}"]] if found[f"min_{f}"] is not None else ())}) for f in FEATURES}


def _counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[tuple[str, bool, float], tuple[int, int]]:
    """For each candidate condition: rejected and kept rows that meet it. One grouped count over (feature, bin)."""

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, thresholds[f])), lambda x: x < F.col(f)))

    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("bin")) for f, t in thresholds.items() if t]))
    seen = rows.select("reject", pairs.alias("p")).groupBy("p.f", "p.bin").agg(F.sum("reject").alias("bad"), F.count("*").alias("n")).collect()
    out = {}
    for f, t in thresholds.items():
        bad, n = [0] * (len(t) + 1), [0] * (len(t) + 1)
        for r in seen:
            if r["f"] == f:
                bad[r["bin"]], n[r["bin"]] = r["bad"], r["n"]
        for k, threshold in enumerate(t):  # bin k holds the values over k thresholds
            low_bad, low_n = sum(bad[: k + 1]), sum(n[: k + 1])
            out[f, False, threshold] = (low_bad, low_n - low_bad)
            out[f, True, threshold] = (sum(bad) - low_bad, sum(n) - low_n - sum(bad) + low_bad)
    return out


def learn(rows: DataFrame, bins: int = 24, max_rules: int = 8, max_conditions: int = 3, min_covered: int = 3, min_precision: float = 0.9) -> list[Rule]:
    """``rows``: the features, ``reject`` (0 or 1) and ``prune`` (boolean), small enough to be read many times."""
    rules: list[Rule] = []
    of = {f: F.col(f) for f in FEATURES}
    thresholds = _thresholds(rows.where(F.col("reject") == 1), bins)
    for f, more in _thresholds(rows, bins).items():
        thresholds[f] = sorted({*thresholds[f], *more})
    if not any(thresholds.values()):
        return []
    left = rows

    def score(data: DataFrame, rule: Rule) -> list[tuple[int, int]]:
        """Rejected and kept rows under each beginning of the rule, longest last."""
        cells = []
        for k in range(1, len(rule) + 1):
            hit = fires(rule[:k], of)
            cells += [F.coalesce(F.sum(F.when(hit, F.col("reject"))), F.lit(0)), F.coalesce(F.sum(F.when(hit, 1 - F.col("reject"))), F.lit(0))]
        got = data.agg(*cells).first()
        return [(int(got[2 * k]), int(got[2 * k + 1])) for k in range(len(rule))]

    while len(rules) < max_rules:
        rule: Rule = ()
        grow = left.where(~F.col("prune"))
        inside, had = grow, None
        while len(rule) < max_conditions:
            found = _counts(inside, thresholds)
            if had is None:
                had = next(((b + found[f, True, t][0], g + found[f, True, t][1]) for (f, up, t), (b, g) in found.items() if not up), (0, 0))
            if not had[0] or not had[1] and rule:
                break
            before = math.log2(max(had[0], 1e-9) / max(sum(had), 1))
            gain = {c: b * (math.log2(b / (b + g)) - before) for c, (b, g) in found.items() if b >= min_covered}
            best = max(gain, key=lambda c: (gain[c], -found[c][1], c), default=None)
            if best is None or gain[best] <= 1e-9 and rule:
                break
            rule, had = (*rule, Condition(best[0], best[1], best[2])), found[best]
            inside = inside.where(rule[-1].column(of))
        if not rule:
            break
        kept = score(left.where(F.col("prune")), rule)
        value = [(b + 1) / (b + g + 2) if b else 0.0 for b, g in kept]
        size = max(range(len(rule)), key=lambda k: (round(value[k], 3), -k)) + 1 if any(b for b, _ in kept) else len(rule)
        rule = rule[:size]
        (b, g), (gb, gg) = kept[size - 1], score(grow, rule)[-1]
        if b + gb < min_covered or (b + gb) < min_precision * (b + gb + g + gg) or b < min_precision * (b + g):
            break
        rules.append(rule)
        left = left.where(~fires(rule, of))
    return rules


def verdict(rules: list[Rule], of: dict[str, Column]) -> tuple[Column, Column]:
    """Whether a row is kept, and the number of the rule that rejects it (from 1; null if none does), as ordered CASEs."""
    which = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        which = F.when(fires(rules[k - 1], of), F.lit(k)).otherwise(which)
    return which.isNull(), which


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **how) -> list[Rule]:
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < (1 << 20) * max_rows // n)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))  # else the filter below goes before the join
    rows = statistics(sample).where(~base_failed())
    rows = rows.select(*[c.alias(f) for f, c in measured().items()], (1 - F.col("quality")).cast("bigint").alias("reject"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).alias("prune"))
    return learn(cut(rows), **how)


def judged(docs: DataFrame, rules: list[Rule], prefix: str = "") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed``, ``kept`` and ``rule`` (the rule that rejects), each name after ``prefix``."""
    stats, failed, kept, rule = (prefix + x for x in ("stats", "base_failed", "kept", "rule"))
    keep, which = verdict(rules, measured(stats))
    out = statistics(docs, out=stats).withColumn(failed, base_failed(stats))
    return out.withColumn(kept, ~F.col(failed) & keep).withColumn(rule, F.when(~F.col(failed), which))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels"))
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs, rules).select("doc_id", *[F.col(f"stats.{s}").alias(s) for s in stats], "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the base rule or the list rejects go.

    Rows are judged one by one by their text: null ids (which no label names), repeated ids and equal rows don't
    matter, a text without words fails the base rule, and other columns pass through under whatever name.
    """
    return judged(docs, train(docs, table(spark, sf_dir, "labels")), "__quality_").where("__quality_kept").select(*docs.columns)
