"""Remember, recall and maintain on a store: golden decisions, replays, budgets, guards and audit rows."""

import pytest
from pyspark.sql import functions as F

from keepsake import engine as E
from keepsake.functions import text
from keepsake.functions import vectors as V
from keepsake.functions.scores import Config
from keepsake.sources.schema import BUDGETS, ITEMS, VECTORS
from keepsake.sources.store import MemoryStore, StoreConflict, StoreError
from tests.golden.scenarios import SCENARIOS
from tests.test_store import item

AT = 1_700_000_000


def writes(spark, rows, subject="u", namespace="n"):
    """rows: (body, key) or dicts of more columns."""
    given = [dict(body=r[0], key=r[1]) if isinstance(r, tuple) else r for r in rows]
    names = E.WRITES.fieldNames()
    return spark.createDataFrame([tuple((dict(subject=subject, namespace=namespace, seq=i, at_s=AT + i) | r).get(n) for n in names) for i, r in enumerate(given)], E.WRITES)


def by_seq(df):
    return [r.asDict() for r in df.orderBy("seq").collect()]


@pytest.fixture
def engine(spark, tmp_path):
    return E.Engine(MemoryStore(spark, f"file://{tmp_path}/store"), "acme")


def held(engine):
    return {r.id: r for r in engine.store.read("items", "acme").collect()}


def decisions(rows):
    return [(r["action"], r["protection"], r["reason"], len(r["evicted"]), r["sensitivity"]) for r in rows]


def test_golden_through_the_store(engine, spark):
    """All scenarios in one call, a scope each."""
    limits, rows = [], []
    for n, (most, ws, _, _) in enumerate(SCENARIOS.values()):
        limits.append(("acme", "user-42", f"s{n}", most, None))
        rows += [dict(namespace=f"s{n}", seq=i, at_s=AT + i, body=b, tags=list(t), hint=h, source_kind="agent", kind="fact") for i, (b, t, h) in enumerate(ws)]
    engine.store.commit(budgets=spark.createDataFrame(limits, BUDGETS))
    got = engine.remember(writes(spark, rows, "user-42")).collect()
    stored, vecs = held(engine).values(), engine.store.read("vectors", "acme").collect()
    for n, (_, _, expected, _) in enumerate(SCENARIOS.values()):
        own = sorted((r for r in got if r.namespace == f"s{n}"), key=lambda r: r.seq)
        assert decisions(own) == list(expected)
        kept = {r["item_id"] for r in own if r["action"] == "retain"} - {e for r in own for e in r["evicted"]}
        assert {r.id for r in stored if r.namespace == f"s{n}"} == kept == {v.item_id for v in vecs if v.namespace == f"s{n}"}
    assert all(len(v.q) == v.dim == 256 for v in vecs)


def test_one_call_a_write(engine, spark):
    """What a scope holds is read back as it was left: the same decisions as in one call."""
    most, ws, expected, _ = next(s for s in SCENARIOS.values() if s[0] is not None)
    engine.store.set_budget("acme", "user-42", "s", most, None)
    df = writes(spark, [dict(body=b, tags=list(t), hint=h, source_kind="agent", kind="fact") for b, t, h in ws], "user-42", "s")
    assert [d for i in range(len(ws)) for d in decisions(by_seq(engine.remember(df.where(F.col("seq") == i))))] == list(expected)


def test_replays_and_conflicts(engine, spark):
    first = by_seq(engine.remember(writes(spark, [("the cat sat on a mat", "k1"), ("the cat sat on a mat", "k1"), ("other words here", "k1"), ("numbers are not words", None)])))
    assert [r["outcome"] for r in first] == ["new", "replayed", "conflict", "new"]
    assert first[1]["item_id"] == first[0]["item_id"] and first[2]["action"] is None
    audit, items = engine.store.read("audit").count(), held(engine)
    again = by_seq(engine.remember(writes(spark, [("the cat sat on a mat", "k1"), ("other words here", "k1")])))
    assert [r["outcome"] for r in again] == ["replayed", "conflict"] and again[0]["item_id"] == first[0]["item_id"]
    assert held(engine) == items and engine.store.read("audit").count() == audit == 2
    # a key is one scope's own
    assert by_seq(engine.remember(writes(spark, [("other words here", "k1")], namespace="m")))[0]["outcome"] == "new"


def test_merge_content_and_audit(engine, spark):
    engine.remember(writes(spark, [dict(body="the cat sat on the mat", tags=["a", "b"], attrs={"x": "1", "y": "1"})]))
    got = by_seq(engine.remember(writes(spark, [dict(body="the cat sat on the mat today", tags=["b", "c"], attrs={"y": "2"}), dict(body="", key="e")])))
    assert [(r["action"], r["reason"]) for r in got] == [("merge", "high_redundancy"), ("reject", "invalid_body")]
    (one,) = held(engine).values()
    assert (one.body, one.tags, one.attrs, one.id) == ("the cat sat on the mat today", ["a", "b", "c"], {"x": "1", "y": "2"}, got[0]["item_id"])
    assert one.byte_size == E.charge(one.asDict())
    log = {r.event: r for r in engine.store.read("audit").collect()}
    assert set(log) == {"admitted", "merged", "rejected"} and log["merged"]["items"][0].id == one.id and not log["rejected"]["items"]
    assert [r["count"] for r in engine.aggregates(policy=("baseline", "0.1.0")).collect()] == [1, 1, 1]
    assert engine.aggregates(until_day=AT // 86_400 - 1).count() == engine.aggregates(policy=(None, None)).count() == 0


def test_refused_calls_and_odd_rows(engine, spark):
    for bad in (dict(body="x", namespace="_admin"), dict(body="x", subject="A B"), dict(body="x", hint="odd"), dict(body="x", at_s=None), dict(body="x", subject=None)):
        with pytest.raises(StoreError):
            engine.remember(writes(spark, [bad]))
    assert engine.remember(writes(spark, []).limit(0)).count() == 0 and not held(engine)
    got = by_seq(engine.remember(writes(spark, [dict(body=None), dict(body="x" * 70_000), dict(body="fine words")])))
    assert [r["action"] for r in got] == ["reject", "reject", "retain"]
    racing = engine.store.state()
    engine.store.set_budget("acme", "u", "n", 5, None)
    with pytest.raises(StoreConflict):
        engine.store.commit(racing, items=engine.store.read("items"))


def test_held_items_bound_later_calls(engine, spark):
    """Pins are never evicted, protections hold until they end, and the oldest free item goes."""
    rows = [item("p", "pinned words", tenant="acme", created_at_s=1, protection="pinned"), item("q", "guarded text", created_at_s=2, protection="protected", protected_until_s=AT + 5), item("o", "old prose", created_at_s=3)]
    engine.store.commit(items=spark.createDataFrame(rows, ITEMS))
    engine.store.set_budget("acme", "u", "n", 3, None)
    got = by_seq(engine.remember(writes(spark, [dict(body="entirely new sentence"), dict(body="unlike anything before", at_s=AT + 1), dict(body="later again", at_s=AT + 10, seq=9)])))
    assert [r["evicted"] for r in got[:1]] == [["o"]] and got[1]["reason"] == "budget_exhausted"
    assert "p" in held(engine) and got[2]["evicted"] == ["q"]


def test_recall(engine, spark):
    bodies = ["apples grow on trees", "pears grow on trees as well", "the engine burns fuel", "my password is hunter2 please"]
    engine.remember(writes(spark, [dict(body=b, kind="fact", tags=[str(i)], hint=text.LEVELS[4] if "password" in b else None) for i, b in enumerate(bodies)]))
    engine.remember(writes(spark, [dict(body="apples grow on trees elsewhere")], namespace="m"))
    chosen, rest, omitted = engine.recall("u", "n", AT + 100, query="apples trees", max_items=2)
    assert chosen[0]["body"] == bodies[0] and len(chosen) == 2 and omitted == len(rest) == 2
    found, _, _ = engine.recall("u", "n", AT + 100, query="password", mode="search", ceiling=1, record=False)
    assert all("password" not in c["body"] for c in found) and len(found) == 3
    assert [c["body"] for c in engine.recall("u", "n", AT, query="trees", tags_any=["1"], record=False)[0]] == [bodies[1]]
    rows = held(engine)
    assert {r.access_count for r in rows.values()} == {0, 1} and sum(r.access_count for r in rows.values()) == 2
    row = engine.store.read("audit").where("event = 'recalled'").first()
    assert [i.id for i in row["items"]] == sorted(c["id"] for c in chosen)
    assert engine.recall("nobody", "n", AT, query="trees", record=False) == ([], [], 0)
    # a probe of another length leaves the keywords; a query without words leaves the vectors
    assert len(engine.recall("u", "n", AT, query="fuel", embedding=[1.0, 0.0], record=False)[0]) == 1
    assert len(engine.recall("u", "n", AT, query="!!", record=False)[0]) == 4
    with pytest.raises(StoreError):
        engine.recall("u", "n", AT, query=" ")


def test_working_set_checks():
    a, b = dict(id="a", estimated_tokens=5, reason="x"), dict(id="b", estimated_tokens=5, reason="x")
    E.check_working_set([a, b], [a, b], 10, 2)
    for chosen, offered, tokens, most in (([a, a], [a], None, None), ([b], [a], None, None), ([a | {"reason": ""}], [a], None, None), ([a, b], [a, b], 9, None), ([a, b], [a, b], None, 1)):
        with pytest.raises(StoreError):
            E.check_working_set(chosen, offered, tokens, most)


def test_maintain_applies(engine, spark):
    day = 86_400
    rows = [
        item("x", "expired note", ttl_seconds=10, created_at_s=5), item("y", "expired but pinned", ttl_seconds=10, created_at_s=6, protection="pinned"),
        item("r", "released one", created_at_s=7, protection="protected", protected_until_s=9),
        item("a", "the quick brown fox", created_at_s=8, tags=["a"], attrs={"k": "1"}), item("b", "the quick brown fox jumps", created_at_s=9, tags=["b"], attrs={"k": "2"}),
        item("z", "another tenant", tenant="other", ttl_seconds=1, created_at_s=1),
    ]
    engine.store.commit(items=spark.createDataFrame(rows, ITEMS), vectors=spark.createDataFrame([("acme", "u", "n", i, "deterministic-256", 256, 1.0, bytearray(256)) for i in "xab"], VECTORS))
    got = engine.maintain(40 * day)
    assert got["scanned"] == 5 and got["forgotten"] == 2 - 1 and got["consolidated"] == 1
    now = held(engine)
    assert "x" not in now and "y" in now and "a" not in now and now["r"].protection == ("normal" if got["released"] else "protected")
    b = now["b"]
    assert b.body == "the quick brown fox jumps\n\nthe quick brown fox" and sorted(b.tags) == ["a", "b"] and b.attrs == {"k": "1"}
    assert b.byte_size == 90 + len("\n\nthe quick brown fox") + 1
    vecs = {v.item_id: v for v in engine.store.read("vectors").collect()}
    assert set(vecs) == {"b"} and any(vecs["b"].q) and engine.store.read("items", "other").count() == 1
    events = sorted(r.event for r in engine.store.read("audit").collect())
    assert events == ["maintenance_run", "merged"]
    # nothing is left to do, and such a run leaves no row
    engine.maintain(40 * day)
    assert engine.store.read("audit").where("event = 'merged'").count() == 1


def test_policy_stats_namespaces(engine, spark):
    assert engine.stats("u", "n")["item_count"] == 0 and engine.stats("u", "n")["embedder"] is None
    engine.remember(writes(spark, [("some words", None)]))
    engine.remember(writes(spark, [("some words", None)], namespace="m"))
    s = engine.stats("u", "n")
    assert (s["item_count"], s["vectors"], s["pending"], s["embedder"], s["dim"]) == (1, 1, 0, "deterministic-256", 256)
    assert engine.namespaces("u") == ["m", "n"]
    engine.set_policy(Config(duplicate_threshold=0.5, merge_threshold=0.4), AT)
    assert engine.store.read("audit").where("event = 'policy_changed' and namespace = '_admin'").count() == 1
    assert by_seq(engine.remember(writes(spark, [("some words again", None)])))[0]["reason"] == "near_duplicate"
    with pytest.raises(ValueError):
        engine.set_policy(Config(merge_threshold=2.0), AT)


def test_packed_codes(spark):
    rows = [([-127, -1, 0, 1, 127],), ([],), (None,)]
    df = spark.createDataFrame(rows, "q array<int>").withColumn("p", V.pack(F.col("q"))).withColumn("u", V.unpack(F.col("p")))
    got = df.collect()
    assert [r.u for r in got] == [r[0] for r in rows] and bytes(got[0].p) == b"\x81\xff\x00\x01\x7f"
