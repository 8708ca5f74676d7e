"""Backfill and re-embedding: each body is embedded once, however many items hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import vectors
from keepsake.functions.embedding import embed_udf


def reembed(items: DataFrame, dim: int = 256, only_pending: bool = True) -> DataFrame:
    """(tenant, subject, namespace, item_id, embedder, dim, scale, codes) of the items without a vector, or of all."""
    todo = items.where("pending_embedding") if only_pending else items
    bodies = todo.select("body").distinct().withColumn("embedding", embed_udf(dim)("body")).where("embedding is not null")
    coded = bodies.withColumn("scale", vectors.scale(F.col("embedding"))).withColumn("codes", vectors.codes(F.col("embedding"), F.col("scale")))
    return todo.join(coded, "body").select("tenant", "subject", "namespace", F.col("id").alias("item_id"), F.lit(f"deterministic-{dim}").alias("embedder"), F.lit(dim).alias("dim"), F.col("scale").cast("float").alias("scale"), "codes")


def done(items: DataFrame, embedded: DataFrame) -> DataFrame:
    """``items`` with the pending mark taken off those that have a vector now."""
    key = ["tenant", "subject", "namespace", "id"]
    have = embedded.select("tenant", "subject", "namespace", F.col("item_id").alias("id"), F.lit(True).alias("_have")).distinct()
    return items.join(have, key, "left").withColumn("pending_embedding", F.col("pending_embedding") & F.col("_have").isNull()).drop("_have")
