"""The store: atomic versions, scope isolation, mutations, archives."""

import pytest
from pyspark.sql import functions as F

from keepsake.sources import portable
from keepsake.sources.schema import AUDIT, ITEMS, VECTORS
from keepsake.sources.store import MemoryStore, StoreConflict, StoreError


def item(id_, body="a body", subject="u", namespace="n", tenant="acme", **more):
    base = dict.fromkeys(ITEMS.fieldNames()) | dict(tenant=tenant, subject=subject, namespace=namespace, id=id_, body=body, kind="fact", source_kind="agent", created_at_s=5, tags=["t"], attrs={}, sensitivity=1, protection="normal", byte_size=90, access_count=0, pending_embedding=False)
    return tuple((base | more)[f] for f in ITEMS.fieldNames())


@pytest.fixture
def store(spark, tmp_path):
    s = MemoryStore(spark, f"file://{tmp_path}/store")
    s.commit(
        items=spark.createDataFrame([item("1"), item("2", "# head\n # more", tags=["x"]), item("3", subject="v"), item("4", tenant="other", protection="pinned")], ITEMS),
        vectors=spark.createDataFrame([("acme", "u", "n", "1", "e", 2, 0.5, bytearray(b"\x01\xff"))], VECTORS),
        audit=spark.createDataFrame([("acme", "a1", 86_401, 1, "u", "n", "admitted", [("1", "d")], "baseline", "0.1.0", 0.5, 0.5, "novel_content", "cli")], AUDIT),
    )
    return s


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tenant_is_a_pruned_partition(store):
    assert ids(store.read("items", "acme")) == ["1", "2", "3"]
    assert "PartitionFilters: [isnotnull(tenant" in store.read("items", "acme")._jdf.queryExecution().toString()
    assert ids(store.get("acme", "u", "n", "3")) == []
    assert ids(store.list_page("acme", "u", "n", offset=1)) == ["2"]


def test_forget_removes_vectors_too(store):
    with pytest.raises(StoreError):
        store.forget("acme", "u", "n", ids=["1"], tag="x")
    store.forget("acme", "u", "n", ids=["1", "3"])
    assert ids(store.read("items")) == ["2", "3", "4"] and store.read("vectors").count() == 0


def test_upsert_keeps_access_statistics(store, spark):
    store.record_recall(store.read("audit").limit(1).withColumn("id", F.lit("a2")))
    assert store.get("acme", "u", "n", "1").first().access_count == 1
    store.upsert(spark.createDataFrame([item("1", "new body"), item("9")], ITEMS))
    one = store.get("acme", "u", "n", "1").first()
    assert (one.body, one.access_count, one.last_access_s) == ("new body", 1, 86_401)
    assert ids(store.read("items")) == ["1", "2", "3", "4", "9"]


def test_protect_and_budget(store):
    store.protect("acme", "u", "n", "1", "protected", 99)
    assert store.get("acme", "u", "n", "1").first().protected_until_s == 99
    for bad in (("1", "protected", None), ("1", "pinned", 5), ("3", "pinned", None)):
        with pytest.raises(StoreError):
            store.protect("acme", "u", "n", *bad)
    store.set_budget("acme", "u", "n", 3, None)
    store.set_budget("acme", "u", "n", 4, None)
    assert [tuple(r) for r in store.read("budgets").collect()] == [("u", "n", 4, None, "acme")] or store.read("budgets").first().max_items == 4


def test_purge(store):
    assert store.purge_subject("acme", "u") == {"removed_items": 2, "removed_vectors": 1, "preserved_audit": 1}
    assert ids(store.read("items")) == ["3", "4"]
    assert sorted((r.event, r.subject) for r in store.read("audit").collect()) == [("admitted", "u"), ("purged", "u")]
    store.purge_subject("acme", "u", cascade_audit=True)
    assert [r.event for r in store.read("audit").collect()] == ["purged"]


def test_archive_round_trip(store, spark, tmp_path):
    path = f"file://{tmp_path}/out"
    portable.write_ndjson(portable.export_lines(store, "acme", 7, with_audit=True), path)
    records = portable.read_ndjson(spark, path)
    assert [r.record for r in records.groupBy("record").count().orderBy("record").collect()] == ["audit", "header", "item"]
    other = MemoryStore(spark, f"file://{tmp_path}/other")
    assert portable.import_into(other, "acme", records, now_s=0) == 3
    assert portable.import_into(other, "acme", records, now_s=0) == 0
    a, b = (sorted(map(str, s.read("items", "acme").select("id", "body", "tags", "created_at_s").collect())) for s in (store, other))
    assert a == b
    with pytest.raises(StoreError):
        portable.import_into(other, "elsewhere", records, now_s=0)
    with pytest.raises(StoreError):
        portable.import_into(other, "acme", records.where("record <> 'header'"), now_s=0)
    (tmp_path / "bad.ndjson").write_text('\n{"record":"header","format_version":1}\nnonsense\n')
    with pytest.raises(Exception, match="not a record"):
        portable.read_ndjson(spark, f"file://{tmp_path}/bad.ndjson").collect()


def test_import_hardens(store, spark):
    rows = spark.createDataFrame([item("7", "password: hunter2", protection="pinned"), item("8", protection="protected", protected_until_s=10**12)], ITEMS)
    head = spark.range(1).select(F.lit("header").alias("record"), F.lit(1).alias("format_version"))
    stream = rows.select(F.lit("item").alias("record"), F.struct(*rows.columns).alias("item")).unionByName(head, allowMissingColumns=True).withColumn("audit", F.lit(None).cast(AUDIT))
    assert portable.import_into(store, "acme", stream, now_s=1000) == 2
    a, b = (store.get("acme", "u", "n", i).first() for i in "78")
    assert (a.sensitivity, a.protection, b.protected_until_s) == (4, "normal", 1000 + 30 * 86_400)


def test_markdown(store):
    out = {r.id: r.value for r in portable.markdown(store.read("items", "acme")).collect()}
    assert out["1"].startswith("# acme / u / n\n\n## 1") and out["2"] == "## 2\n\n\\# head\n \\# more\n"


def test_other_version_is_refused(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "current.json").write_text('{"version": 1, "tables": {}}')
    with pytest.raises(StoreError):
        MemoryStore(spark, f"file://{tmp_path}/s")


def test_every_mutation_leaves_its_audit_row(store):
    store.forget("acme", "u", "n", tag="x", now_s=86_400 * 3)
    store.protect("acme", "u", "n", "1", "pinned", now_s=5)
    store.set_budget("acme", "u", "n", 3, None, now_s=6)
    rows = {r.event: r for r in store.read("audit").collect()}
    assert set(rows) == {"admitted", "forgotten", "protected", "policy_changed"}
    assert [i.id for i in rows["forgotten"]["items"]] == ["2"] and rows["forgotten"].day == 3 and rows["policy_changed"].reason == "max_items 3, max_bytes None"


def test_a_writer_that_dies_loses_nothing(store, spark, monkeypatch, tmp_path):
    """Before the pointer, while it is written, and with a torn pointer left behind."""
    before = ids(store.read("items"))

    def die(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_point", die)
        with pytest.raises(KeyboardInterrupt):
            store.forget("acme", "u", "n", ids=["1"])
    assert ids(MemoryStore(spark, store.root).read("items")) == before
    torn = tmp_path / "store" / f"pointer-{store.state():012d}.json"
    torn.write_text('{"version": 2, "tab')
    again = MemoryStore(spark, store.root)
    assert ids(again.read("items")) == before
    again.forget("acme", "u", "n", ids=["1"])
    assert ids(MemoryStore(spark, store.root).read("items")) == before[1:]
    assert again.vacuum(keep=1) >= 1 and ids(again.read("items")) == before[1:]


def test_a_folder_without_pointers_is_not_made_anew(store, spark, tmp_path):
    for f in (tmp_path / "store").glob("pointer-*"):
        f.unlink()
    with pytest.raises(StoreError):
        MemoryStore(spark, store.root)


def test_of_two_writers_one_is_refused(store, spark):
    other = MemoryStore(spark, store.root)
    at = store.state()
    mine, theirs = store.read("items").where("id <> '1'"), other.read("items").where("id <> '3'")
    other.commit(at, items=theirs)
    with pytest.raises(StoreConflict):
        store.commit(at, items=mine)
    with pytest.raises(StoreConflict):
        store._point(at, {})  # the number is taken, even if both had seen the same state
    assert ids(store.read("items")) == ["1", "2", "4"]


def test_import_brings_the_vectors(store, spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    portable.write_ndjson(portable.export_lines(store, "acme", 7), path)
    to = MemoryStore(spark, f"file://{tmp_path}/to")
    assert portable.import_into(to, "acme", portable.read_ndjson(spark, path), 9) == 3
    key = ["tenant", "subject", "namespace", "item_id", "embedder", "dim", "scale", "q"]
    assert [tuple(r[k] for k in key) for r in to.read("vectors").collect()] == [tuple(r[k] for k in key) for r in store.read("vectors").collect()] != []
    assert {r.id: r.pending_embedding for r in to.read("items").collect()} == {"1": False, "2": True, "3": True}
    assert [(r.event, r.reason) for r in to.read("audit").collect()] == [("imported", "3 items")]
    assert portable.import_into(to, "acme", portable.read_ndjson(spark, path), 9) == 0 and to.read("vectors").count() == 1
