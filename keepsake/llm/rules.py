"""Learned decision lists: sequential covering over threshold conjunctions.

Each rule rejects what satisfies all its thresholds. A rule is grown on two
thirds of the labelled rows by information gain and pruned on the rest, then the
rows it covers are set aside and the next is grown, until no rule is precise
enough. The list comes out as one ordered ``CASE WHEN`` over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_prefix
from .textstats import COUNTS, with_counts

#: Labelled rows fitted on at most (the ones with the smallest hash of their id).
LABELLED_ROWS = 20_000
MIN_WORDS = 50
#: A repeated share, in percent of the words, above which a text fails at once.
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # >= threshold if true, else <= threshold
    threshold: float


def features(prefix: str = "") -> dict[str, Column]:
    """Ratios of the counts; 0 where there is nothing to divide by."""
    c = lambda name: F.col(prefix + name)
    per = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "symbols": per("n_symbols", "word_chars"), "marks": per("n_marks", "word_chars"), "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"), "repeats": per("n_repeat_words", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
        "word_length": per("word_chars", "n_words"), "distinct": per("n_distinct_words", "n_words"), "words": c("n_words").cast("double"),
    }


def _mask(rule: list[Test], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        v = x[:, names.index(t.feature)]
        out &= (v >= t.threshold) if t.above else (v <= t.threshold)
    return out


def _precision(rule: list[Test], x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    hit = _mask(rule, x, names)
    return (bad[hit].sum() + 0.5) / (hit.sum() + 1.0)


def _best_split(v: np.ndarray, bad: np.ndarray) -> tuple[float, bool, float]:
    """(gain, above, threshold) of the best split of one feature, over all its values.

    The gain is that of covering bad rows: how many are kept, times the bits by
    which their share rises. Thresholds lie halfway between neighbouring values.
    """
    order = np.argsort(v, kind="stable")
    v, bad = v[order], bad[order]
    ends = np.flatnonzero(v[1:] != v[:-1])  # last row of each value but the largest
    if not len(ends):
        return 0.0, True, 0.0
    low_bad, low_all = np.cumsum(bad)[ends], ends + 1
    now, best = np.log2(bad.mean()), (0.0, True, 0.0)
    for above, hits, rows in ((True, bad.sum() - low_bad, len(v) - low_all), (False, low_bad, low_all)):
        gain = hits * (np.log2(np.maximum(hits, 1e-9) / rows) - now)
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), above, float((v[ends[i]] + v[ends[i] + 1]) / 2))
    return best


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int) -> list[Test]:
    rule: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest and bad[inside].any() and not bad[inside].all():
        found = [_best_split(x[inside, j], bad[inside]) for j in range(len(names))]
        j = max(range(len(names)), key=lambda i: found[i][0])
        if found[j][0] <= 0:
            break
        rule.append(Test(names[j], found[j][1], found[j][2]))
        inside &= _mask(rule[-1:], x, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], hold_out: np.ndarray, precision: float = 0.9, longest: int = 4) -> list[list[Test]]:
    """Ordered rules for ``bad`` rows; ``hold_out`` marks the rows used for pruning.

    A rule has ``longest`` thresholds at most, so that it can be read. Covering
    ends when the next rule would be less precise than ``precision``, or when
    fewer than three bad rows are left to grow it on.
    """
    left, rules = np.ones(len(x), bool), []
    while True:
        grow, prune = left & ~hold_out, left & hold_out
        if bad[grow].sum() < 3:
            break
        rule = _grow(x[grow], bad[grow], names, longest)
        while len(rule) > 1 and _precision(rule[:-1], x[prune], bad[prune], names) >= _precision(rule, x[prune], bad[prune], names):
            rule = rule[:-1]
        hit = _mask(rule, x, names) & left if rule else np.zeros(len(x), bool)
        if not rule or bad[hit].sum() < 3 or bad[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_condition(rules: list[list[Test]], prefix: str = "") -> Column:
    """True where a text passes the list."""
    col = features(prefix)
    test = lambda t: col[t.feature] >= t.threshold if t.above else col[t.feature] <= t.threshold
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        met = reduce(lambda a, b: a & b, [test(t) for t in rule])
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed(prefix: str = "") -> Column:
    words, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (again * 100 > words * MAX_REPEAT_PERCENT)


def labelled(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """One label per key (the worst where they differ), ``most`` keys by smallest hash: small enough to broadcast."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64("_key"), "_key").limit(most)


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", prefix: str = "", most: int = LABELLED_ROWS) -> list[list[Test]]:
    """Fits on the counts of at most ``most`` labelled rows that the base rules let through; label 0 is bad."""
    some = labelled(labels, key, label, most)
    feats = features(prefix)
    names = list(feats)
    rows = stats.join(F.broadcast(some), stats[key] == some["_key"]).where(~base_failed(prefix))
    rows = rows.select(F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(3)).alias("_fold"), "_label", *[feats[n].alias(n) for n in names])
    # repeated keys can add rows beyond the bound: keep the bound
    found = rows.orderBy(F.hash(*names), *names).limit(most).toPandas()
    if found.empty:
        return []
    return learn(found[names].to_numpy(float), (found["_label"] == 0).to_numpy(), names, (found["_fold"] == 0).to_numpy())


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> tuple[DataFrame, list[list[Test]]]:
    """(key, the counts, ``base_failed``, ``kept`` for every row; the rules).

    Null and empty texts count as 0 words and fail the base rules. Without
    labels of both kinds the list is empty and the base rules decide. Repeated
    rows are judged alike; an empty table gives no rows; other columns of the
    input are left out. The whole text is read once.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(with_counts(docs, text, [key]), "counts")
    rules = fit(stats, labels, key, label)
    out = stats.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & as_condition(rules)).select(key, *COUNTS, "base_failed", "kept"), rules


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, with the columns they came with."""
    prefix = free_prefix(docs)
    some = labelled(labels, key, label, LABELLED_ROWS)
    sample = docs.join(F.broadcast(some), docs[key] == some["_key"], "left_semi")
    rules = fit(with_counts(sample, text, [key], prefix), labels, key, label, prefix)
    judged = with_counts(docs, text, None, prefix)
    return judged.where(~base_failed(prefix) & as_condition(rules, prefix)).select(*docs.columns)
