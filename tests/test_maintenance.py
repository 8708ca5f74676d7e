"""Maintenance phases, replay of archives, identities and settings."""

import random

import pytest

from keepsake.functions.scores import Config
from keepsake.operators import maintenance as M
from keepsake.operators import replay
from keepsake.sources import identity, portable
from keepsake.sources.schema import AUDIT, ITEMS
from keepsake.sources.store import MemoryStore, StoreError
from tests.test_store import item

NOW = 100 * 86_400


def one(i, body, created=0, **more):
    return {"id": i, "body": body, "created_at_s": created, "ttl_seconds": None, "protection": "normal", "protected_until_s": None, "byte_size": 10} | more


def decide(page, max_items=None, max_bytes=None):
    return [(d["phase"], d["id"], d["into"]) for d in M.decide(page, len(page), 10 * len(page), max_items, max_bytes, NOW)]


def test_expiry_frees_capacity_before_reclaim():
    page = [one("a", "x y", 5), one("b", "z w", 1, ttl_seconds=1), one("c", "q r", 3)]
    assert decide(page, max_items=2) == [("expire", "b", None)]
    assert ("reclaim", "c", None) in decide(page, max_items=1)


def test_pinned_and_protected_stay():
    page = [one("a", "x y", 1, protection="pinned"), one("b", "z w", 2, protection="protected", protected_until_s=NOW + 1), one("c", "q r", 3)]
    assert [d for d in decide(page, max_items=0) if d[0] == "reclaim"] == [("reclaim", "c", None)]


def test_release_and_merge():
    page = [one("a", "the cat sat", 1), one("b", "the cat sat down", 2), one("c", "other words", 3, protection="protected", protected_until_s=NOW)]
    assert decide(page) == [("release", "c", None), ("merge", "a", "b")]


def test_equal_bodies_absorb_the_later():
    assert decide([one("a", "x y", 1), one("b", "x y", 2), one("c", "x y", 3)]) == [("merge", "b", "a")]


def test_last_neighbour_removed_regrants():
    page = [one("a", "alpha beta", 1, ttl_seconds=1), one("b", "alpha beta gamma", 2)]
    assert [(p, i) for p, i, _ in decide(page)] == [("expire", "a"), ("regrant", "b")]


def test_pages_through_spark(spark, monkeypatch):
    rows = [("s", "n", f"{i:03}", "same words here" if i < 4 else f"w{i} v{i}", i, None, "normal", None, 10) for i in range(9)]
    df = spark.createDataFrame(rows, "subject string, namespace string, id string, body string, created_at_s long, ttl_seconds long, protection string, protected_until_s long, byte_size long")
    state = spark.createDataFrame([("s", "n", 9, 90, 8, None)], "subject string, namespace string, used_items long, used_bytes long, max_items long, max_bytes long")
    got = M.run(df, state, ["subject", "namespace"], NOW)
    assert {(r.phase, r.id, r.into) for r in got.collect()} == {("reclaim", "000", None), ("merge", "002", "001")}
    assert M.report(got, 9) == {"scanned": 9, "forgotten": 1, "released": 0, "regranted": 0, "consolidated": 1}


@pytest.mark.parametrize("limits", [(40, None), (None, 400), (30, 350), (57, 10_000)])
def test_pages_see_what_earlier_pages_have_left(spark, monkeypatch, limits):
    """Against deciding page after page with the capacity read anew; pages hold 7 of 60 items."""
    monkeypatch.setattr(M, "PAGE", 7)
    r = random.Random(sum(x or 1 for x in limits))
    rows = []
    for i in range(60):
        kind = r.choice(["normal", "normal", "normal", "pinned", "protected"])
        rows.append(("s", "n", f"{i:03}", f"w{i} v{i} u{i}", i // 2, r.choice([None, None, 5, NOW * 2]), kind, r.choice([NOW - 1, NOW + 9]) if kind == "protected" else None, r.randint(5, 15)))
    df = spark.createDataFrame(rows, "subject string, namespace string, id string, body string, created_at_s long, ttl_seconds long, protection string, protected_until_s long, byte_size long")
    used_items, used_bytes = 60, sum(x[-1] for x in rows)
    state = spark.createDataFrame([("s", "n", used_items, used_bytes, *limits)], "subject string, namespace string, used_items long, used_bytes long, max_items long, max_bytes long")
    got = {(d["page"], d.phase, d.id) for d in M.run(df, state, ["subject", "namespace"], NOW).collect() if d.phase in ("expire", "reclaim")}
    want = set()
    fields = ["id", "body", "created_at_s", "ttl_seconds", "protection", "protected_until_s", "byte_size"]
    for p in range(0, 60, 7):
        page = [dict(zip(fields, x[2:])) for x in rows[p : p + 7]]
        size = {i["id"]: i["byte_size"] for i in page}
        for d in M.decide(page, used_items, used_bytes, *limits, NOW):
            if d["phase"] in ("expire", "reclaim"):
                want.add((p // 7, d["phase"], d["id"]))
                used_items, used_bytes = used_items - 1, used_bytes - size[d["id"]]
    assert got == want and any(w[1] == "reclaim" for w in want)


def archive(spark, tmp_path, with_audit=True):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    audit = [("acme", f"a{i}", 5, 0, "u", "n", e, refs, None, None, None, None, None, None) for i, (e, refs) in enumerate([("admitted", [("1", "d")]), ("merged", [("1", "d")]), ("recalled", []), ("admitted", [("9", "d")]), ("admitted", []), ("rejected", None)])]
    store.commit(items=spark.createDataFrame([item("1"), item("2")], ITEMS), audit=spark.createDataFrame(audit, AUDIT))
    path = f"file://{tmp_path}/archive"
    portable.write_archive(store, "acme", path, 5, with_audit=with_audit)
    with pytest.raises(StoreError):
        portable.write_archive(store, "acme", path, 5)
    return path


def test_archive_to_scenario(spark, tmp_path):
    records = portable.read_archive(spark, archive(spark, tmp_path))
    writes, rest = replay.scenario(records)
    assert [(r.at, r.id) for r in writes.collect()] == [("a0", "1")]
    assert {r.audit_id: r.why for r in rest.collect()} == {"a1": replay.WHY["merged"], "a2": "not a write", "a3": "the item is not in the archive", "a4": "the row names no item", "a5": replay.WHY["rejected"]}
    assert replay.coverage(writes, rest) == 1 / 6


def test_archive_without_audit_and_changed_archive(spark, tmp_path):
    path = archive(spark, tmp_path, with_audit=False)
    writes, rest = replay.scenario(portable.read_archive(spark, path))
    assert sorted(r.id for r in writes.collect()) == ["1", "2"] and replay.coverage(writes, rest) == 1.0
    spark.createDataFrame([('{"record":"header","format_version":1}',)], "value string").write.mode("append").text(f"{path}/memories.ndjson")
    with pytest.raises(StoreError):
        portable.read_archive(spark, path)


def test_identity(tmp_path):
    assert identity.pick_namespace(None, " ns ", "d") == "ns" and identity.pick_namespace() == "default"
    for bad in ("_admin", "Upper", ".x", "a" * 241):
        with pytest.raises(identity.Refused):
            identity.pick_namespace(bad)
    assert identity.parse_resource("mem://t/s/n/audit") == ("t", "s", "n", "audit")
    with pytest.raises(identity.Refused):
        identity.parse_resource("mem://t/s/audit")
    secret, key = identity.generate_key("t", "s")
    assert identity.authenticate(secret, [key]) is key and key.digest not in secret
    for presented, keys in ((secret[:-1] + "~", [key]), ("msk_x_y", [key]), (secret, [identity.ApiKey(**{**key.__dict__, "disabled": True})])):
        with pytest.raises(identity.Refused):
            identity.authenticate(presented, keys)
    f = tmp_path / "c.toml"
    f.write_text('tenant = "t"\n[policy]\nmmr_lambda = 0.5\n')
    got = identity.load_settings(str(f))
    assert got.policy == Config(mmr_lambda=0.5) and got.data_dir == str(tmp_path / "tenants")
    for text in ('nonsense = 1', 'retention = "x"', "[policy]\nmmr_lambda = 2.0"):
        f.write_text(text)
        with pytest.raises(ValueError):
            identity.load_settings(str(f))


