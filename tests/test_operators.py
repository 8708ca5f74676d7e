"""Working sets, streaming, and column builders on small inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsake.functions import scores, text
from keepsake.operators import admission, auditing, composing, governance, retrieval
from keepsake.streaming import streams


def cand(i, body, rel, tokens=5, due=False):
    return {"id": str(i), "body": body, "relevance": rel, "estimated_tokens": tokens, "due": due}


def test_fill_prefers_what_is_not_covered():
    chosen, rest = composing.working_set([cand(1, "a b c", 0.9), cand(2, "a b c", 0.89), cand(3, "x y z", 0.7)], None, 2)
    assert [c["id"] for c in chosen] == ["1", "3"] and [c["id"] for c in rest] == ["2"]


def test_replay_stops_and_fill_passes_over():
    cands = [cand(1, "a", 0.9, 100, due=True), cand(2, "b", 0.8, 5, due=True), cand(3, "c", 0.7, 5)]
    chosen, _ = composing.working_set(cands, 20, 10)
    assert [(c["id"], c["reason"]) for c in chosen] == [("2", "high_value"), ("3", "high_value")]  # the first due item doesn't fit, so none is replayed
    chosen, _ = composing.working_set([cand(1, "a", 0.1, due=True), cand(2, "b", 0.9)], None, 5)
    assert [(c["id"], c["reason"]) for c in chosen] == [("1", "replay_due"), ("2", "high_value")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a b", "b c", "c d e", ""]), st.floats(0, 1), st.integers(1, 30), st.booleans()), max_size=12), st.integers(0, 60), st.integers(0, 6))
def test_budgets_hold(rows, tokens, most):
    cands = [cand(i, *r) for i, r in enumerate(rows)]
    chosen, rest = composing.working_set(cands, tokens, most)
    assert sum(c["estimated_tokens"] for c in chosen) <= tokens and len(chosen) <= most
    assert sorted(c["id"] for c in chosen + rest) == sorted(c["id"] for c in cands)
    assert [c["relevance"] for c in rest] == sorted((c["relevance"] for c in rest), reverse=True)


BODIES = ["password: x", "take 5 mg daily", "my iban", "under seal", "write a@b.c now", "a@b. x", "@b.c", "call +49 30 1234 5678", "tok sk-abc123def456ghi789jkl012", "plain words", "(abcdefghij0123456789)", "abcdefghijklmnopqrstuv", "Salary: 5", "x@y@z.q", ""]


def test_sensitivity_columns_agree_with_the_fold(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "i long, body string")
    got = {r.i: r.level for r in df.withColumns(text.sensitivity(F.col("body"))).select("i", text.level().alias("level")).collect()}
    assert got == {i: admission.sensitivity(b) for i, b in enumerate(BODIES)}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)] == [4, 3, 3, 3, 2, 1, 1, 2, 4, 1]


def test_text_builders(spark):
    df = spark.createDataFrame([("Ab  b AB", "My Name!"), ("", "..")], "body string, name string")
    got = df.select(text.tokens(F.col("body")).alias("t"), text.estimated_tokens(F.col("body")).alias("n"), text.slug(F.col("name")).alias("s"), text.valid_component(F.col("name")).alias("ok"), text.valid_body(F.col("body")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(["ab", "b", "ab"], 3, "my-name", False, True), ([], 1, "default", False, False)]


def test_score_builders(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (3, 0.5, 0.5), (3, 0.25, 0.5), (3, 0.75, 0.5)], "n int, d double, b double")
    assert [r[0] for r in df.select(scores.fragility(F.col("n"), F.col("d"), F.col("b"))).collect()] == [1.0, 0.5, 0.75, 0.25]
    v = spark.createDataFrame([(0.98,), (0.95,), (0.5,), (float("nan"),)], "x double")
    assert [r[0] for r in v.select(scores.verdict(F.col("x"))).collect()][:3] == ["near_duplicate", "mergeable", "novel"]
    assert v.select(scores.clamped(F.col("x")).alias("c")).collect()[3].c == 0.0
    p = spark.createDataFrame([(0,), (9,), (10,), (99,), (100,)], "p int")
    assert [r[0] for r in p.select(scores.score_bucket(F.col("p"))).collect()] == [0, 0, 1, 9, 9]


def test_upper_median(spark):
    rows = [("s", "n", str(i), b) for i, b in enumerate([5, 1, 9, 3])] + [("s", "m", "x", 7)]
    got = {r.namespace: (r.item_count, r.total_bytes, r.median_item_bytes) for r in governance.scope_stats(spark.createDataFrame(rows, "subject string, namespace string, id string, byte_size long")).collect()}
    assert got == {"n": (4, 18, 5), "m": (1, 7, 7)}


def test_coverage_pairs_against_all_pairs(spark):
    import random

    r = random.Random(3)
    sets = {i: sorted({r.choice("abcdefghij") for _ in range(r.randint(0, 7))}) for i in range(40)}
    df = spark.createDataFrame([("k", str(i), t) for i, t in sets.items()], "g string, id string, tokens array<string>")
    got = {(p.a_id, p.b_id) for p in retrieval.coverage_pairs(df, df, ["g"], 0.8).collect()}
    assert got == {(str(i), str(j)) for i, a in sets.items() for j, b in sets.items() if i != j and a and len(set(a) & set(b)) / len(a) >= 0.8}


def test_idempotency(spark):
    rows = [("t", "s", "n", "k", "a", 1), ("t", "s", "n", "k", "a", 2), ("t", "s", "n", "k", "b", 3), ("t", "s", "m", "k", "b", 3)]
    df = spark.createDataFrame(rows, "tenant string, subject string, namespace string, key string, body string, at int")
    assert sorted(r.outcome for r in governance.idempotent(df, "at").collect()) == ["conflict", "new", "new", "replayed"]


def test_query_needs_a_term():
    with pytest.raises(ValueError):
        retrieval.query_terms(" \0 .. ")
    assert retrieval.engine_limit(None) == 160 and retrieval.engine_limit(1) == 10 and retrieval.engine_limit(1000) == 500


def test_aggregates_and_cursor(spark):
    rows = [(1, "p", "1", "admitted", 100, 5), (1, None, None, "recalled", None, None), (1, "p", "1", "admitted", 95, 10)]
    df = spark.createDataFrame(rows, "day long, policy_name string, policy_version string, event string, value_pct int, fragility_pct int")
    agg = auditing.aggregates(df)
    one = agg.where("event = 'admitted'").first()
    assert one["count"] == 2 and one.value_histogram == [0] * 9 + [2] and one.fragility_histogram == [1, 1] + [0] * 8
    assert agg.where(auditing.after_cursor(1, None, None, "recalled")).count() == 1
    assert agg.where(auditing.after_cursor(1, "p", "1", "admitted")).count() == 0


def test_stream_runs_once_over_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 60), (2, "b", 86_400)], "user_id long, event_type string, s long")
    df.select("user_id", "event_type", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "events"))
    got = streams.drain(streams.day_counts(streams.events(spark, str(tmp_path / "events"))), "complete", "t")
    assert sorted(tuple(r) for r in got.collect()) == [(0, "a", 2), (1, "b", 1)]
