"""Counts, decision lists and the co-trained classifier."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import classifier, rules
from keepsake.llm.textstats import COUNTS, counts, with_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


@pytest.mark.parametrize("seed", range(40))
def test_counts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "b", "é", " ", "\n", "\t", "%", "#x", "\x0b", " ", "Ab "]) for _ in range(r.choice([0, 5, 60, 300])))
    got = dict(zip(COUNTS, counts(text)))
    assert {k: got[k] for k in brute(text)} == brute(text)


def test_null_text_counts_nothing():
    assert counts(None) == (0,) * len(COUNTS) == counts("")


def corpus(spark, n=400):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [r.choice("lorem ipsum dolor sit amet consectetur elit sed tempor magna aliqua veniam".split()) + str(r.randint(0, 99)) for _ in range(r.randint(55, 90))]
        docs.append((i, " ".join(w + "%%%" if bad else w for w in words), f"s{i % 3}", "en", 5, i, True))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    docs += [(900, None, None, None, None, 1, False), (901, "", "s1", "en", 0, 1, False), (902, "too short", "s1", "en", 9, 1, False), (903, "same same same " * 30, "s1", "en", 9, 1, False), (0, docs[0][1], "s0", "en", 5, 0, True)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long, n_words long, accepted boolean").repartition(3)
    return d, spark.createDataFrame([*labels, (0, 0), (None, 1), (2, None)], "doc_id long, quality int")


def test_decision_list(spark):
    docs, labels = corpus(spark)
    got, learnt = rules.judge(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 404 and got.count() == 405
    assert learnt and learnt[0][0].feature in ("symbols", "word_length")
    assert all(rows[i].kept == (i % 4 != 0) for i in range(400))
    assert [rows[i].base_failed for i in (900, 901, 902, 903)] == [True] * 4
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 4]


def test_decision_list_without_labels(spark):
    docs, labels = corpus(spark, 40)
    got, learnt = rules.judge(docs, labels.limit(0))
    assert learnt == [] and all(r.kept != r.base_failed for r in got.collect())
    assert rules.judge(docs.limit(0), labels)[0].collect() == []


def test_learned_rules_fit_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.6))
    fold = np.arange(4000) % 3 == 0
    found = rules.learn(x[:3000], bad[:3000], ["a", "b", "c"], fold[:3000])
    hit = np.zeros(1000, bool)
    for rule in found:
        hit |= rules._mask(rule, x[3000:], ["a", "b", "c"])
    assert (hit == bad[3000:]).mean() > 0.95


def test_classifier(spark):
    docs, labels = corpus(spark)
    model = classifier.fit(docs, labels, ["source", "lang", "n_chars"])
    got = {r.doc_id: r for r in classifier.score(docs, model, keep=["doc_id"]).collect()}
    assert sum(got[i].accepted == (i % 4 != 0) for i in range(400)) >= 396  # half of them are held out
    kept = classifier.keep_accepted(docs, model)
    assert kept.columns == docs.columns
    assert 0 < got[900].p_good < 1
    assert classifier.score(docs.limit(0), model, keep=["doc_id"]).collect() == []


def telling_corpus(spark, n=1500):
    """Both views tell good from bad; a third of the rows are labelled."""
    r = random.Random(11)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        words = [r.choice("lorem ipsum dolor sit amet consectetur".split()) + str(r.randint(0, 99)) for _ in range(60)]
        noisy = r.random() < 0.03
        rows.append((i, " ".join(w + "%%%" if bad != noisy else w for w in words), "https://{}.example.org/p/{}".format("spam" if bad else r.choice("abc"), i), float(r.randint(1, 9))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string, score double").repartition(3)
    return docs, spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, n, 3)], "doc_id long, quality int")


def test_labels_pass_both_ways_and_do_no_harm(spark):
    docs, labels = telling_corpus(spark)
    right = {}
    for rounds in (0, classifier.ROUNDS):
        model = classifier.fit(docs, labels, ["url", "score"], rounds=rounds)
        got = classifier.score(docs, model, keep=["doc_id"]).collect()
        right[rounds] = sum(g.accepted == (g.doc_id % 5 != 0) for g in got)
    assert len(model.handed) == classifier.ROUNDS
    for view in ("text", "meta"):
        assert sum(n for step in model.handed for (v, _), n in step.items() if v == view) > 100
    assert any(step.get(("meta", 0)) for step in model.handed) and any(step.get(("text", 0)) for step in model.handed)
    assert right[classifier.ROUNDS] >= right[0] - 7 and right[0] >= 1400  # the 3 % noise decides single rows


def test_surest_are_the_best_of_all_rows(spark):
    docs, _ = telling_corpus(spark, 300)
    again = docs.unionByName(docs.limit(50))  # equal rows count once
    seen = classifier.view_rows(again.select("text", docs["url"].alias("m0")), 1, [])
    rng = np.random.default_rng(1)
    w = {"text": rng.normal(size=classifier.WORD_SLOTS + classifier.RATIOS + 1), "meta": rng.normal(size=classifier.META_SLOTS + 1)}
    all_rows = seen.toPandas().drop_duplicates("hash").assign(label=1, fold=1)
    rows = classifier.Rows.of(all_rows)
    hashes = all_rows.sort_values(["hash", "label", "fold"])["hash"].to_numpy()
    known = {"text": {int(hashes[0]), int(hashes[5])}, "meta": set()}
    least = {("text", 1): -1e9, ("text", 0): 0.5, ("meta", 0): -1e9}
    got = classifier.surest(seen.repartition(5), w, least, {1: 7, 0: 4}, known)
    for (view, label), cut in least.items():
        z = classifier._score(rows.views()[view].astype(np.float64), w[view]) * (1 if label else -1)
        want = sorted((-z[i], h) for i, h in enumerate(hashes.tolist()) if z[i] >= cut and h not in known[view])[: 7 if label else 4]
        assert set(got[(got["view"] == view) & (got["label"] == label)]["hash"]) == {h for _, h in want}


def test_logistic_and_platt_reach_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.logistic(size=400) > 0.3).astype(int)
    w = classifier.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert np.abs(np.r_[x.T @ (p - y) / 400 + 1e-3 * w[:3], (p - y).mean()]).max() < 1e-3
    score = x @ [1.0, -2.0, 0.5]
    a, b = classifier.platt(score, y)
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (400 - y.sum() + 2)
    t = np.where(y == 1, hi, lo)
    loss = lambda a, b: (np.logaddexp(0, a * score + b) - t * (a * score + b)).sum()
    grid = min(loss(i, j) for i in np.linspace(0, 3, 61) for j in np.linspace(-2, 2, 81))
    assert loss(a, b) <= grid + 1e-2


def test_logistic_copies_no_rows():
    """The driver holds the labelled rows once, without copies for the fit."""
    rng = np.random.default_rng(1)
    x = rng.random((1500, 1000)).astype(np.float32)
    y = (x[:, 0] > 0.5).astype(int)
    tracemalloc.start()
    try:
        w = classifier.logistic([x[:900], x[900:]], y, steps=20)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < x.nbytes / 4
    assert np.allclose(w, classifier.logistic(x, y, steps=20), atol=1e-4)


def test_sure_from_keeps_to_the_precision_and_to_whole_ties():
    y = np.array([1] * 40 + [0, 1] * 10)
    score = np.r_[np.full(40, 2.0), np.zeros(20)]
    assert classifier.sure_from(score, y, 1) == 2.0
    assert classifier.sure_from(-score, y, 0) == float("inf") == classifier.sure_from(score[:0], y[:0], 1)


def test_metadata_of_any_kind(spark):
    import datetime

    nan, inf = float("nan"), float("inf")
    values = [[None, nan, inf], ["x", -inf, -5], [datetime.date(2024, 1, 1), True, b"q"], ["http://A.b/c", 0, 3.5]]
    assert all(len(classifier.meta_view(v)) == 4 for v in values)
    assert classifier.meta_view(["http://a.B/x"])[0] == classifier.meta_view(["https://A.b/y?z"])[0]
    docs = spark.createDataFrame([(i, "some words " * 40, [nan, inf, -inf, None, 2.0][i % 5], datetime.date(2024, 1, 1 + i % 9)) for i in range(40)], "doc_id long, text string, v double, day date")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, ["v", "day"])
    assert classifier.score(docs, model).count() == 40
    assert classifier.score(docs.withColumn("text", F.repeat("text", F.lit(2000))).limit(3), model).count() == 3  # very long texts


def test_classifier_without_labels_accepts_all(spark):
    docs, labels = corpus(spark, 20)
    model = classifier.fit(docs, labels.limit(0), ["source"])
    assert {r.p_good for r in classifier.score(docs, model, keep=["doc_id"]).collect()} == {0.5}


def test_with_counts_keeps_columns(spark):
    docs, _ = corpus(spark, 12)
    out = with_counts(docs, prefix="q_")
    assert out.columns == [*docs.columns, *[f"q_{c}" for c in COUNTS]]
    assert out.count() == docs.count()
