"""One maintenance run: expiries, releases, re-grants, merges and reclaims, in that order, page by page.

A page (200 items of a scope, oldest first) is decided on its own, scopes and
pages in parallel; capacity is what earlier pages have left of the whole scope's,
known from running sums of expiries and reclaims (merges free nothing for later
pages of the same run). Only pages are grouped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import scores
from keepsake.functions.embedding import split_white
from keepsake.functions.scores import BASELINE, Config

PAGE, DAY = 200, 86_400
PHASES = ["expire", "release", "regrant", "merge", "reclaim"]


def _covered(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a) if a else 0.0


def _fragility(similarities: list[float]) -> float:
    """As at admission, against a baseline of 0: alone is 1, like others is below 0.5."""
    if not similarities:
        return 1.0
    density = min(1.0, sum(sorted(similarities, reverse=True)[:3]) / min(3, len(similarities)))
    return 0.5 - 0.5 * density if density > 0 else 0.5


def decide(page: list[dict], used_items: int, used_bytes: int, max_items: int | None, max_bytes: int | None, now: int, cfg: Config = BASELINE) -> list[dict]:
    """Decisions over one page; items hold id, body, created_at_s, ttl_seconds, protection, protected_until_s, byte_size."""
    words = {i["id"]: {t.lower() for t in split_white(i["body"] or "")} for i in page}
    free = {i["id"]: i["protection"] == "normal" or (i["protection"] == "protected" and i["protected_until_s"] is not None and i["protected_until_s"] <= now) for i in page}
    gone, out = set(), {p: [] for p in PHASES}
    for i in page:
        if i["ttl_seconds"] is not None and i["created_at_s"] + i["ttl_seconds"] <= now:
            gone.add(i["id"])
            out["expire"].append({"id": i["id"], "reason": "ttl_expired"})
    items, size = max(0, used_items - len(gone)), max(0, used_bytes - sum(i["byte_size"] for i in page if i["id"] in gone))
    over = lambda: (max_items is not None and items > max_items) or (max_bytes is not None and size > max_bytes)
    for i in sorted(page, key=lambda i: i["created_at_s"]):  # equal costs: oldest first, page order among equals
        if not over():
            break
        if i["id"] not in gone and free[i["id"]]:
            gone.add(i["id"])
            items, size = items - 1, size - i["byte_size"]
            out["reclaim"].append({"id": i["id"], "reason": "capacity_pressure"})
    left = [i for i in page if i["id"] not in gone]
    granted = set()
    if gone:
        for i in left:
            if not free[i["id"]]:
                continue
            near = {j["id"]: _covered(words[i["id"]], words[j["id"]]) for j in page if j is not i}
            was, is_now = _fragility(list(near.values())), _fragility([near[j["id"]] for j in left if j is not i])
            if is_now > was and is_now >= cfg.protection_fragile_threshold:
                granted.add(i["id"])
                out["regrant"].append({"id": i["id"], "reason": "protected_fragile", "until_s": now + cfg.protection_window_days * DAY})
    released = set()
    for i in left:
        if i["protection"] == "protected" and free[i["id"]] and i["id"] not in granted:
            released.add(i["id"])
            out["release"].append({"id": i["id"], "reason": "protected_fragile"})
    taken, barred = set(), gone | granted | released
    ordered = sorted(left, key=lambda i: (i["created_at_s"], i["id"]))
    for n, a in enumerate(ordered):
        for b in ordered[n + 1 :]:
            if a["id"] in taken:
                break
            if b["id"] in taken:
                continue
            ways = [(_covered(words[x["id"]], words[y["id"]]), x["created_at_s"], x["id"], y["id"]) for x, y in ((a, b), (b, a))]
            for share, _, absorbed, target in sorted(ways, reverse=True):
                if share >= cfg.merge_threshold and free[absorbed] and absorbed not in barred:
                    taken |= {absorbed, target}
                    out["merge"].append({"id": absorbed, "reason": "high_redundancy", "into": target})
                    break
    return [{"phase": p, "into": None, "until_s": None} | d for p in PHASES for d in out[p]]


def run(items: DataFrame, state: DataFrame, scope: list[str], now: int, cfg: Config = BASELINE) -> DataFrame:
    """(scope, page, phase, id, reason, into, until_s). ``state``: scope, used_items, used_bytes, max_items, max_bytes."""
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("created_at_s", "id"))
    rows = items.withColumn("page", F.floor((place - 1) / PAGE).cast("long")).join(state, scope)
    # each page sees the capacity that earlier pages have left: expiries up to a page come before its reclaims, and these
    # take the oldest free items, so the reclaimed ones are those that still find the scope over its limits
    in_order = Window.partitionBy(*scope).orderBy("created_at_s", "id")
    by_page = Window.partitionBy(*scope).orderBy("page")
    upto, earlier = by_page.rangeBetween(Window.unboundedPreceding, 0), by_page.rangeBetween(Window.unboundedPreceding, -1)
    ahead = in_order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n, over: F.coalesce(F.sum(n).over(over), F.lit(0))
    rows = rows.withColumn("_x", scores.expired(F.col("created_at_s"), F.col("ttl_seconds"), now))
    rows = rows.withColumn("_f", ~F.col("_x") & F.coalesce(scores.evictable(F.col("protection"), F.col("protected_until_s"), now), F.lit(False)))
    one, size = lambda c: F.when(F.col(c), 1).otherwise(0), lambda c: F.when(F.col(c), F.col("byte_size")).otherwise(0)
    items_left = F.col("used_items") - total(one("_x"), upto) - total(one("_f"), ahead)
    bytes_left = F.col("used_bytes") - total(size("_x"), upto) - total(size("_f"), ahead)
    rows = rows.withColumn("_e", F.col("_x") | (F.col("_f") & scores.would_exceed(items_left, bytes_left, F.col("max_items"), F.col("max_bytes"), 0, 0)))
    rows = rows.withColumns({"used_items": F.col("used_items") - total(one("_e"), earlier), "used_bytes": F.col("used_bytes") - total(size("_e"), earlier)})
    fields = ["id", "body", "created_at_s", "ttl_seconds", "protection", "protected_until_s", "byte_size"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created_at_s", "id"])
        first = pdf.iloc[0]
        number = lambda v: None if pd.isna(v) else int(v)
        page = [{f: (v if f in ("id", "body", "protection") else number(v)) for f, v in r.items()} for r in pdf[fields].to_dict("records")]
        got = decide(page, int(first["used_items"]), int(first["used_bytes"]), number(first["max_items"]), number(first["max_bytes"]), now, cfg)
        out = pd.DataFrame(got, columns=["phase", "id", "reason", "into", "until_s"])
        out["until_s"] = out["until_s"].astype("Int64")
        for c in [*scope, "page"]:
            out[c] = first[c]
        return out[[*scope, "page", "phase", "id", "reason", "into", "until_s"]]

    types = ", ".join(f"{c} {t}" for c, t in items.dtypes if c in scope)
    needed = rows.select(*scope, "page", *fields, "used_items", "used_bytes", "max_items", "max_bytes")
    return needed.groupBy(*scope, "page").applyInPandas(one, f"{types}, page long, phase string, id string, reason string, into string, until_s long")


def report(decisions: DataFrame, scanned: int) -> dict[str, int]:
    counts = {r["phase"]: r["count"] for r in decisions.groupBy("phase").count().collect()}
    return {"scanned": scanned, "forgotten": counts.get("expire", 0) + counts.get("reclaim", 0), "released": counts.get("release", 0), "regranted": counts.get("regrant", 0), "consolidated": counts.get("merge", 0)}
