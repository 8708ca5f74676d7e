"""Audit log: filters, keyset pages, daily aggregates with score histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import scores

DEFAULT_PAGE, LARGEST_PAGE = 100, 1000
KEY = ["day", "policy_name", "policy_version", "event"]


def filtered(audit: DataFrame, events: list[str] | None = None, item: str | None = None, since_s: int | None = None, until_s: int | None = None, after: str | None = None, subject=None) -> DataFrame:
    if events:
        audit = audit.where(F.col("event").isin(events))
    if item is not None:
        audit = audit.where(F.exists("items", lambda x: x == item))
    if since_s is not None:
        audit = audit.where(F.col("at_s") >= since_s)
    if until_s is not None:
        audit = audit.where(F.col("at_s") <= until_s)
    if subject is not None:
        audit = audit.where(F.col("subject") == subject)
    return audit if after is None else audit.where(F.col("id") < after)


def page(audit: DataFrame, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The newest rows, at most ``limit`` (1 to 1000)."""
    limit = max(1, min(limit, LARGEST_PAGE))
    return audit.orderBy(F.desc("id")).limit(limit)


def page_and_more(audit: DataFrame, limit: int = DEFAULT_PAGE) -> tuple[DataFrame, bool]:
    """The page, and whether it is cut short: one row more than the limit is asked for."""
    limit = max(1, min(limit, LARGEST_PAGE))
    return page(audit, limit), audit.orderBy(F.desc("id")).limit(limit + 1).count() > limit


def aggregates(audit: DataFrame) -> DataFrame:
    """Count and two ten-bucket histograms per (day, policy, event)."""
    bucket = {c: scores.score_bucket(F.col(f"{c}_pct")) for c in ("value", "fragility")}
    cells = [F.count_if(bucket[c] == i).alias(f"{c}{i}") for c in bucket for i in range(10)]
    out = audit.groupBy(*KEY).agg(F.count(F.lit(1)).alias("count"), *cells)
    hist = {f"{c}_histogram": F.array(*[f"{c}{i}" for i in range(10)]) for c in bucket}
    return out.select(*KEY, "count", *[v.alias(k) for k, v in hist.items()])


def after_cursor(day: int, name: str | None, version: str | None, event: str) -> Column:
    """Strictly behind the cursor in the order day, policy (none first), version, event."""
    key = F.struct(F.col("day").alias("a"), F.col("policy_name").isNotNull().alias("b"), F.coalesce("policy_name", F.lit("")).alias("c"), F.coalesce("policy_version", F.lit("")).alias("d"), F.col("event").alias("e"))
    at = F.struct(F.lit(day).cast("long").alias("a"), F.lit(name is not None).alias("b"), F.lit(name or "").alias("c"), F.lit(version or "").alias("d"), F.lit(event).alias("e"))
    return key > at


def latest_reason(audit: DataFrame) -> DataFrame:
    """The newest decided audit row of each item: an aggregate that combines before the shuffle, no window."""
    best = F.max(F.struct("id", "event")).alias("last")
    return audit.where(F.col("policy_name").isNotNull()).groupBy("item_id").agg(best).select("item_id", F.col("last.id").alias("audit_id"), F.col("last.event").alias("event"))


def access_stats(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("event") == "recalled").groupBy("item_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("at_s").alias("last_access_s"))


def retained(audit: DataFrame, now_s: int, days: int | None) -> DataFrame:
    """Detail rows inside a profile's span; the aggregates outlive them."""
    return audit if days is None else audit.where(F.col("at_s") >= now_s - days * 86_400)
