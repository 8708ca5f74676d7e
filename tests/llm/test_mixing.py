"""Raking against a plain iteration, and the sampling it drives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import mixing as M


def plain(base, targets, rounds=200):
    w = base / base.sum()
    for _ in range(rounds):
        for axis, t in enumerate(targets):
            held = w.sum(axis=tuple(a for a in range(3) if a != axis))
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * np.divide(t, held, out=np.zeros_like(t), where=held > 0).reshape(shape)
    return w


def test_rake(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    targets = [rng.dirichlet(np.ones(k)) for k in base.shape]
    cells = spark.createDataFrame([(str(i), str(j), str(k), int(base[i, j, k])) for i in range(4) for j in range(3) for k in range(2)], "a string, b string, c string, _tokens long")
    tables = {d: spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(t)], f"{d} string, _share double") for d, t in zip("abc", targets)}
    raked, residual = M.rake(cells, ["a", "b", "c"], tables)
    got = {(r.a, r.b, r.c): r._weight for r in raked.collect()}
    assert residual < M.CLOSE
    want = plain(base, targets)
    assert max(abs(got[str(i), str(j), str(k)] - want[i, j, k]) for i in range(4) for j in range(3) for k in range(2)) < 1e-4


def test_rounds_have_small_plans(spark, monkeypatch):
    """What the driver plans and broadcasts at once doesn't grow with the rounds: it has to hold all of it."""
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(str(i), str(j), str(k), int(rng.integers(1, 1000))) for i in range(4) for j in range(3) for k in range(2)], "a string, b string, c string, _tokens long")
    tables = {d: spark.createDataFrame([(str(i), 1 / n) for i in range(n)], f"{d} string, _share double") for d, n in zip("abc", (4, 3, 2))}
    joins, save = [], M.Scratch.save

    def counted(self, df, name, by=None):
        joins.append(sum(" Join " in line or line.startswith("Join ") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return save(self, df, name, by)

    monkeypatch.setattr(M.Scratch, "save", counted)
    raked, residual = M.rake(cells, ["a", "b", "c"], tables)
    assert residual < M.CLOSE and raked.count() == 24
    assert len(joins) > 6 and max(joins) <= 3


def test_targets_that_exclude_each_other(spark):
    """Each value of one dimension goes with one of the other: shares of both cannot be chosen."""
    cells = spark.createDataFrame([("x", "1", 10), ("y", "2", 30)], "a string, b string, _tokens long")
    targets = {d: spark.createDataFrame([(v, s) for v, s in zip(vs, ss)], f"{d} string, _share double") for d, vs, ss in (("a", "xy", (0.5, 0.5)), ("b", "12", (0.2, 0.8)))}
    with pytest.raises(M.RakingError):
        M.rake(cells, ["a", "b"], targets, rounds=4)
    raked, residual = M.rake(cells, ["a", "b"], targets, rounds=4, strict=False)
    assert abs(residual - 0.3) < 1e-9 and {r.a: round(r._weight, 6) for r in raked.collect()} == {"x": 0.2, "y": 0.8}
    tied = spark.createDataFrame([(i, "some text " * 30, "xxxy"[i % 4], "1112"[i % 4]) for i in range(40)], "doc_id long, text string, source string, lang string")
    assert M.mix(tied).count() == 40  # tempered alike, so they can be met
    with pytest.raises(M.RakingError):
        M.mix(tied, targets={"source": targets["a"].withColumnRenamed("a", "source"), "lang": targets["b"]})


def shares(rows, by, weight):
    out = {}
    for r in rows:
        out[r[by]] = out.get(r[by], 0.0) + weight(r)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_default_targets_move_the_shares(spark):
    rows = M.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), keep=["doc_id", "source", "lang"]).collect()
    for by in ("source", "lang", "_topic"):
        was, now = (shares(rows, by, w) for w in (lambda r: r._tokens, lambda r: r._tokens * r._probability))
        root = {k: v ** (M.TOPIC_TEMPER if by == "_topic" else M.TEMPER) for k, v in was.items()}
        want = {k: v / sum(root.values()) for k, v in root.items()}
        assert sum(abs(now[k] - want[k]) for k in want) <= 2 * M.CLIPPED
        assert sum(abs(now[k] - was[k]) for k in was) > 0.02


def test_one_rare_cell_does_not_set_the_scale(spark):
    """A single tiny document of a wanted language would else leave one in thousands of the others."""
    df = spark.createDataFrame([(i, "word " * 200, "s", "en" if i else "xx") for i in range(2000)], "doc_id long, text string, source string, lang string")
    want = spark.createDataFrame([("en", 0.99), ("xx", 0.01)], "lang string, _share double")
    assert sum(r._probability for r in M.mix(df, targets={"lang": want}).collect()) > 1900


def docs(spark):
    rows = [(i, ["", "a " * (i % 90), "x|y " * 20, None, "STOP! " * 9][i % 5], ["hot", "hot", "hot", "a", None][i // 5 % 5], ["en", "de"][i // 25 % 2], "t", 1) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _topic string, key int").repartition(3)


def test_sample(spark):
    df = docs(spark)
    keep = ["doc_id", "source", "lang"]
    share = spark.createDataFrame([("hot", 0.5), ("a", 0.3), (None, 0.2)], "source string, _share double")
    got = M.mix(df, targets={"source": share}, keep=keep)
    rows = got.collect()
    assert len(rows) == 3000 and all(0 < r._probability <= 1 for r in rows)
    assert max(r._probability for r in rows) == 1
    # expected tokens of the sample have the target shares
    weight = {}
    for r in rows:
        weight[r.source] = weight.get(r.source, 0) + r._tokens * r._probability
    total = sum(weight.values())
    want = {"hot": 0.5, "a": 0.3, None: 0.2}
    assert weight.keys() == want.keys() and all(abs(v / total - want[k]) <= M.CLIPPED for k, v in weight.items())
    n, expected = sum(r._sampled for r in rows), sum(r._probability for r in rows)
    assert abs(n - expected) < 5 * (sum(r._probability * (1 - r._probability) for r in rows) ** 0.5 + 1)
    kept = M.sample(df)
    assert kept.columns == df.columns and 0 < kept.count() <= 3000
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in M.sample(df.repartition(7)).collect())


def test_topics_and_long_texts(spark):
    texts = [None, "", "<b>x</b> {y} | z", "1234 5678 words", "a\nb\nc\nd\ne", "word " * 300_000, "few words", "some words of prose, " * 40]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.topic(F.col("t")).alias("topic")).orderBy("i").collect()
    assert [r.topic for r in got] == ["empty", "empty", "marked up", "figures", "short lines", "long form", "short form", "prose"]


def test_empty(spark):
    assert M.sample(docs(spark).limit(0)).collect() == []


def test_native(spark):
    plan = M.mix(docs(spark), keep=["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
