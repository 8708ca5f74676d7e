from keepsake.functions.embedding import DeterministicEmbedder, quantize
from keepsake.operators.reembedding import done, reembed
from keepsake.sources.schema import ITEMS
from tests.test_store import item


def test_backfill(spark):
    rows = [item("1", "the cat sat", pending_embedding=True), item("2", "the cat sat", pending_embedding=True), item("3", "a dog"), item("4", " ", pending_embedding=True)]
    df = spark.createDataFrame(rows, ITEMS)
    got = {r.item_id: r for r in reembed(df).collect()}
    assert sorted(got) == ["1", "2"]
    q, s = quantize(DeterministicEmbedder().embed("the cat sat"))
    assert list(got["1"].codes) == q.tolist() and abs(got["1"].scale - s) < 1e-9
    assert {r.id: r.pending_embedding for r in done(df, reembed(df)).collect()} == {"1": False, "2": False, "3": False, "4": True}
    assert reembed(df, only_pending=False).count() == 3
