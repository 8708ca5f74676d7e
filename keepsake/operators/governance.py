"""Capacity, evictions, maintenance phases, merges and purges over scoped items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import scores

SCOPE = ["subject", "namespace"]
EVICTION_CANDIDATES = 128


def scope_stats(items: DataFrame) -> DataFrame:
    """Item count, bytes and the upper median of byte_size per scope.

    The median is read from a histogram of sizes (one row a distinct size), not
    from the rows, so a hot scope is pre-aggregated before any window.
    """
    sizes = items.groupBy(*SCOPE, "byte_size").agg(F.count(F.lit(1)).alias("k"))
    by = Window.partitionBy(*SCOPE)
    ranked = sizes.withColumn("upto", F.sum("k").over(by.orderBy("byte_size"))).withColumn("n", F.sum("k").over(by)).withColumn("total", F.sum(F.col("k") * F.col("byte_size")).over(by))
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*SCOPE).agg(F.first("n").alias("item_count"), F.first("total").alias("total_bytes"), F.min("byte_size").alias("median_item_bytes"))


def used(items: DataFrame) -> DataFrame:
    return items.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("used_items"), F.sum("byte_size").alias("used_bytes"))


def prefix_evictions(ranked: DataFrame, order: list, admit_items: int, admit_bytes: int) -> DataFrame:
    """Adds ``place`` and ``evicted``: the smallest prefix of each scope whose removal makes the admission fit.

    ``ranked`` holds used_items, used_bytes, max_items, max_bytes on every row.
    """
    by = Window.partitionBy(*SCOPE).orderBy(*order)
    place = F.row_number().over(by)
    freed = F.coalesce(F.sum("byte_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranked.withColumn("place", place).withColumn("_freed", freed)
    still = scores.would_exceed(F.greatest(F.col("used_items") - (F.col("place") - 1), F.lit(0)), F.greatest(F.col("used_bytes") - F.col("_freed"), F.lit(0)), F.col("max_items"), F.col("max_bytes"), admit_items, admit_bytes)
    return out.withColumn("evicted", still).drop("_freed")


def greedy_consolidation(pairs: DataFrame) -> DataFrame:
    """Each item takes part in one merge at most: pairs in (created_at, id) order of both, the better option of each."""

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_created", "first_id", "second_created", "second_id", "coverage", "absorbed_created", "absorbed"], ascending=[True] * 4 + [False] * 3)
        claimed, out = set(), []
        for r in pdf.itertuples():
            if r.first_id not in claimed and r.second_id not in claimed:
                claimed |= {r.first_id, r.second_id}
                out.append((r.subject, r.namespace, r.absorbed, r.target, r.coverage))
        return pd.DataFrame(out, columns=["subject", "namespace", "absorbed", "target", "coverage"])

    return pairs.groupBy(*SCOPE).applyInPandas(claim, "subject string, namespace string, absorbed string, target string, coverage double")


def merged(target: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``target`` with ``new`` folded in: tags in order without repeats, attributes overlaid, the new body."""
    n = new.select(F.col("target_id"), F.col("tags").alias("_tags"), F.col("source_kind").alias("_kind"), F.col("value_weight").alias("_weight"), F.col("id").alias("new_id"), F.col("body").alias("_body"))
    out = target.join(n, F.col("id") == F.col("target_id"))
    return out.withColumns({
        "tags": F.array_union("tags", "_tags"), "source_kind": F.col("_kind"), "value_weight": F.coalesce("_weight", "value_weight"), "body": F.col("_body"),
    }).drop("_tags", "_kind", "_weight", "_body", "target_id")


def idempotent(writes: DataFrame, order: str) -> DataFrame:
    """Adds ``outcome``: the first write of a key is new; later ones replay it, or conflict if their body differs."""
    by = Window.partitionBy("tenant", "subject", "namespace", "key").orderBy(order)
    digest = F.md5("body")
    first = F.first(digest).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.row_number().over(by) == 1, "new").when(digest == first, "replayed").otherwise("conflict")
    return writes.withColumn("outcome", outcome)
