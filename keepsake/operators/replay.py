"""From an archive to a scenario: which writes can be replayed, and what was decided then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Why an audit row has no write to replay.
WHY = {"merged": "its content was folded into the target", "rejected": "nothing was stored"}


def scenario(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writes, unreplayable) of the records of an archive.

    With audit rows, the admitted ones are the writes, in audit order; without,
    the items are, by id. ``at`` orders the writes (sequence numbers would need a
    global sort; the fold orders by it within a scope).
    """
    items = records.where(F.col("record") == "item").select("item.*")
    audit = records.where(F.col("record") == "audit").select("audit.*")
    fields = ["tenant", "subject", "namespace", "body", "kind", "tags", "ttl_seconds", "sensitivity", "protection"]
    if audit.isEmpty():
        writes = items.select(F.col("id").alias("at"), "id", *fields)
        return writes, audit.select(F.col("id").alias("audit_id"), "event", F.lit("").alias("why")).limit(0)
    named = audit.select(F.col("id").alias("audit_id"), "event", F.try_element_at("items", F.lit(1))["id"].alias("item_id"))
    joined = named.join(items, named["item_id"] == items["id"], "left")
    why = F.when(F.col("event").isin(*WHY), F.create_map(*[F.lit(x) for p in WHY.items() for x in p])[F.col("event")]).when(F.col("event") != "admitted", "not a write")
    why = F.coalesce(why, F.when(F.col("item_id").isNull(), "the row names no item"), F.when(F.col("id").isNull(), "the item is not in the archive"))
    marked = joined.withColumn("why", why)
    return marked.where("why is null").select(F.col("audit_id").alias("at"), "id", *fields), marked.where("why is not null").select("audit_id", "event", "why")


def coverage(writes: DataFrame, unreplayable: DataFrame) -> float:
    """Replayable share of all; 1 if there is nothing."""
    n, m = writes.count(), unreplayable.count()
    return n / (n + m) if n + m else 1.0
