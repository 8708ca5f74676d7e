"""The stages against plain Python, on the small tables and on odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from keepsake.llm import classifier, rules
from keepsake.llm.common import META, table, tokenizer_path
from keepsake.llm.mixing import CLIPPED, TEMPER, TOPIC_TEMPER, topic, uniform
from keepsake.llm.textstats import COUNTS, counts
from tests.conftest import tables
from tests.llm.test_packing import decreasing


def plain_classifier(spark, docs, sf_dir):
    model = classifier.fit(spark.createDataFrame(docs, SCHEMA), table(spark, sf_dir, "labels"), META)
    return [d for d in docs if model.log_odds(d[1], [d[3], d[2], d[4]])[2] >= 0]


def plain_rules(spark, docs, sf_dir):
    _, learnt = rules.judge(spark.createDataFrame(docs, SCHEMA), table(spark, sf_dir, "labels"))

    def good(text):
        c = dict(zip(COUNTS, counts(text)))
        if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
            return False
        per = lambda a, b: c[a] / c[b] if c[b] else 0.0
        f = {
            "symbols": per("n_symbols", "word_chars"), "marks": per("n_marks", "word_chars"), "upper": per("n_upper", "word_chars"), "digits": per("n_digits", "word_chars"), "repeats": per("n_repeat_words", "n_words"),
            "dup_lines": per("n_dup_lines", "n_lines"), "word_length": per("word_chars", "n_words"), "distinct": per("n_distinct_words", "n_words"), "words": float(c["n_words"]),
        }
        return not any(all(f[t.feature] >= t.threshold if t.above else f[t.feature] <= t.threshold for t in rule) for rule in learnt)

    return [d for d in docs if good(d[1])]


def plain_join(docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for d in docs:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = {i: i for i in range(len(docs))}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)), key=lambda x: docs[x][0])
                low[b] = a
    return [d for i, d in enumerate(docs) if find(i) == i]


def plain_mixing(spark, docs):
    rows = spark.createDataFrame(docs, SCHEMA).select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), F.octet_length("text").alias("b"), uniform("doc_id", 11).alias("u")).collect()
    cells = {}
    for r in rows:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + max(1, -(-r.b // 4))
    tokens = dict(cells)
    total = sum(tokens.values())
    w = {k: v / total for k, v in tokens.items()}
    targets = []
    for axis, power in enumerate((TEMPER, TEMPER, TOPIC_TEMPER)):
        sums = {}
        for k, v in tokens.items():
            sums[k[axis]] = sums.get(k[axis], 0) + v
        targets.append({k: v**power / sum(x**power for x in sums.values()) for k, v in sums.items()})
    for _ in range(60):
        for axis, t in enumerate(targets):
            held = {}
            for k, v in w.items():
                held[k[axis]] = held.get(k[axis], 0) + v
            w = {k: v * t[k[axis]] / held[k[axis]] for k, v in w.items()}
    rates = sorted((w[k] / tokens[k], w[k]) for k in w)
    cut = np.searchsorted(np.cumsum([x for _, x in rates]), 1 - CLIPPED)
    most = rates[cut][0]
    chance = {k: min(1.0, w[k] / tokens[k] / most) for k in w}
    keep = {r.doc_id: (chance[r.source, r.lang, r.topic], r.u) for r in rows}
    return keep


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_against_plain_python(spark):
    sf_dir = tables()
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").collect()]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    now = table(spark, sf_dir, "documents")
    stages = dict(P.STAGES)
    for name, plain in (("quality classifier", plain_classifier), ("quality rules", plain_rules), ("n-gram Jaccard join", lambda s, d, f: plain_join(d))):
        out = stages[name](spark, now, sf_dir)
        want = plain(spark, docs, sf_dir)
        assert out.columns == now.columns and ids(out) == sorted(d[0] for d in want) and len(want) > 60
        docs, now = want, spark.createDataFrame(want, SCHEMA)
    keep = plain_mixing(spark, docs)
    out = ids(P.source_mixing(spark, now, sf_dir))
    sure = {k for k, (p, u) in keep.items() if abs(p - u) > 1e-3}
    assert {k for k in out if k in sure} == {k for k in sure if keep[k][1] < keep[k][0]} and len(sure) > len(keep) - 3
    docs = [d for d in docs if d[0] in set(out)]
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, lengths = [], {}
    for d in docs:
        found = tok.encode(d[1], add_special_tokens=False).ids + [0]
        for i in range(0, len(found), 2048):
            part = np.array(found[i : i + 2048], "<u4")
            want.append((d[0], i // 2048, i, len(part), zlib.crc32(part.tobytes())))
            lengths[len(part)] = lengths.get(len(part), 0) + 1
    got = P.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == sorted(want)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1]) and sum(n for _, n in parts) <= 2048
    assert len(fill) <= decreasing(lengths, 2048)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    words = lambda n: " ".join(f"word{r.randint(0, 5000)}" for _ in range(n))
    one = words(80)
    rows = [
        (1, one, "en", "s", 5), (1, one, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, words(70), "en", "s", 5), (4, words(60_000), "de", "t", 5),
        (5, one + " tail", "en", "t", 5), (6, words(90), None, "s", -3), *[(10 + i, words(60 + i), "en", "su"[i % 2], 400) for i in range(20)],
    ]
    return spark.createDataFrame([(*x, "kept", True, 1.0, "b") for x in rows], SCHEMA + ", kept string, accepted boolean, p_good double, body string")


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_odd_rows_through_every_stage(spark, odd, name, stage):
    out = stage(spark, odd, tables())
    rows = out.collect()
    if name == "best-fit packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
        assert sum(r.piece == 0 for r in rows) == odd.count()
    else:
        assert out.columns == odd.columns and 0 < len(rows) <= odd.count() and set(rows) <= set(odd.collect())
        assert len([r for r in rows if r.doc_id == 1]) == (1 if "Jaccard" in name else 2) or "mixing" in name or "classifier" in name
    assert stage(spark, odd.limit(0), tables()).collect() == []


def test_names():
    from keepsake.llm import registry

    names = list(registry.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)] and names[10] == "pipeline"
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
