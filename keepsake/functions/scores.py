"""Column builders for value, fragility, redundancy, capacity and eviction."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Thresholds of the baseline policy (fixed values by default)."""

    duplicate_threshold: float = 0.98
    merge_threshold: float = 0.93
    near_duplicate_floor: float = 0.30
    protection_fragile_threshold: float = 0.85
    replay_fragile_threshold: float = 0.80
    replay_stale_fragile_threshold: float = 0.50
    protection_window_days: int = 30
    replay_quota: float = 0.20
    mmr_lambda: float = 0.70
    diversity_cut_similarity: float = 0.50
    source_trust_weight: float = 0.20
    replay_stale_days: float = 30.0
    content_specificity_weight: float = 0.6
    caller_weight_weight: float = 0.25
    specificity_median_floor_bytes: int = 50

    def validate(self) -> "Config":
        """Shares lie in [0, 1], thresholds are ordered, the window is 0 to 36500 days."""
        for f in fields(self):
            v = getattr(self, f.name)
            if v < 0 or (isinstance(v, float) and f.name != "replay_stale_days" and v > 1):
                raise ValueError(f"{f.name} is out of range: {v}")
        if not self.near_duplicate_floor <= self.merge_threshold <= self.duplicate_threshold:
            raise ValueError("near_duplicate_floor, merge_threshold, duplicate_threshold must not fall")
        if self.protection_window_days > 36_500:
            raise ValueError("protection_window_days is out of range")
        return self


BASELINE = Config()
BLEND_VECTOR, BLEND_KEYWORD = 0.7, 0.3


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def specificity(size: Column, median: Column, cfg: Config = BASELINE) -> Column:
    ratio = size / F.greatest(median, F.lit(cfg.specificity_median_floor_bytes))
    return ratio / (1 + ratio)


def trust(source_kind: Column) -> Column:
    return F.when(source_kind == "human", 1.0).when(source_kind == "tool", 0.7).otherwise(0.5)


def value(spec: Column, density: Column, source_kind: Column, weight: Column | None = None, cfg: Config = BASELINE) -> Column:
    content = cfg.content_specificity_weight * spec + (1 - cfg.content_specificity_weight) * density
    base = (1 - cfg.source_trust_weight) * content + cfg.source_trust_weight * trust(source_kind)
    if weight is None:
        return clamped(base)
    called = cfg.caller_weight_weight * clamped(weight.cast("double")) + (1 - cfg.caller_weight_weight) * base
    return clamped(F.when(weight.isNull(), base).otherwise(called))


def fragility(neighbours: Column, density: Column, baseline: Column) -> Column:
    """1 without neighbours, 0.5 at the baseline density, more when sparser and less when denser."""
    sparser = 0.5 + 0.5 * (baseline - density) / baseline
    denser = 0.5 - 0.5 * (density - baseline) / (1 - baseline)
    return clamped(F.when(neighbours == 0, 1.0).when(density < baseline, sparser).when(density > baseline, denser).otherwise(0.5))


def verdict(best: Column, cfg: Config = BASELINE) -> Column:
    return F.when(best >= cfg.duplicate_threshold, "near_duplicate").when(best >= cfg.merge_threshold, "mergeable").otherwise("novel")


def blend(vector: Column, keyword: Column) -> Column:
    both = BLEND_VECTOR * vector + BLEND_KEYWORD * keyword
    return F.when(vector.isNotNull() & keyword.isNotNull(), both).otherwise(F.coalesce(vector, keyword))


def squash(bm25: Column) -> Column:
    positive = F.greatest(bm25, F.lit(0.0))
    return positive / (1 + positive)


def evictable(protection: Column, until_s: Column, now_s: int) -> Column:
    return F.when(protection == "normal", True).when(protection == "pinned", False).otherwise(until_s <= now_s)


def expired(created_s: Column, ttl_s: Column, now_s: int) -> Column:
    return F.coalesce(created_s + ttl_s <= now_s, F.lit(False))


def replay_due(fragile: Column, last_access_s: Column, created_s: Column, now_s: int, cfg: Config = BASELINE) -> Column:
    stale = now_s - F.coalesce(last_access_s, created_s) >= int(cfg.replay_stale_days) * 86_400
    return (fragile >= cfg.replay_fragile_threshold) | (stale & (fragile >= cfg.replay_stale_fragile_threshold))


def would_exceed(used_items: Column, used_bytes: Column, max_items: Column, max_bytes: Column, items: int | Column, size: int | Column) -> Column:
    over = F.coalesce(used_items + items > max_items, F.lit(False))
    return over | F.coalesce(used_bytes + size > max_bytes, F.lit(False))


def pressure(used: Column, most: Column) -> Column:
    return F.when(most == 0, 1.0).otherwise(F.least(F.lit(1.0), used / most))


def score_bucket(pct: Column) -> Column:
    """Bucket 0 to 9 of a score given in hundredths: lower edges belong, 1.0 is in the last."""
    return F.least(F.lit(9), F.floor(pct / 10)).cast("int")
