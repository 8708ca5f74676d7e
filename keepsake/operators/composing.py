"""Working sets: replay reservation, then relevance traded against coverage, under a token and item budget."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

from keepsake.functions.embedding import split_white
from keepsake.functions.scores import BASELINE, Config

OMITTED = 50


def token_set(body: str) -> set[str]:
    return {t.lower() for t in split_white(body)}


def working_set(candidates: list[dict], max_tokens: int | None, max_items: int | None, cfg: Config = BASELINE) -> tuple[list[dict], list[dict]]:
    """(chosen with ``place`` and ``reason``, the rest by relevance).

    Candidates hold id, body, relevance, estimated_tokens, due. Replay takes due
    items in rank order and stops at the first that doesn't fit; the fill takes
    the largest lambda * relevance - (1 - lambda) * coverage and passes over what
    doesn't fit; of equal values the better ranked wins.
    """
    ranked = sorted(candidates, key=lambda c: (-c["relevance"], c["id"]))
    words = [token_set(c["body"]) for c in ranked]
    chosen: list[dict] = []
    open_at, used, covered = dict.fromkeys(range(len(ranked))), 0, set()

    def fits(i: int) -> bool:
        return (max_tokens is None or used + ranked[i]["estimated_tokens"] <= max_tokens) and (max_items is None or len(chosen) + 1 <= max_items)

    def share(i: int) -> float:
        return len(words[i] & covered) / len(words[i]) if words[i] else 0.0

    def take(i: int, reason: str) -> None:
        nonlocal used
        used += ranked[i]["estimated_tokens"]
        covered.update(words[i])
        del open_at[i]
        chosen.append(ranked[i] | {"place": len(chosen) + 1, "reason": reason})

    slots = math.floor((len(ranked) if max_items is None else max_items) * cfg.replay_quota)
    for i in list(open_at):
        if len(chosen) >= slots:
            break
        if ranked[i]["due"]:
            if not fits(i):
                break
            take(i, "replay_due")
    while True:
        best, most = None, -math.inf
        for i in open_at:
            if fits(i):
                gain = cfg.mmr_lambda * ranked[i]["relevance"] - (1 - cfg.mmr_lambda) * share(i)
                if math.isfinite(gain) and gain > most:
                    best, most = i, gain
        if best is None:
            return chosen, [ranked[i] for i in open_at]
        take(best, "diversity_cut" if share(best) > cfg.diversity_cut_similarity else "high_value")


def compose(candidates: DataFrame, by: list[str], max_tokens: int | None = 2000, max_items: int | None = 20, cfg: Config = BASELINE) -> DataFrame:
    """One working set per request (group of ``by``); a request's candidates are bounded by the engine's limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, _ = working_set(pdf.to_dict("records"), max_tokens, max_items, cfg)
        rows = [[*[c[b] for b in by], c["id"], c["place"], c["reason"], c["relevance"]] for c in chosen]
        return pd.DataFrame(rows, columns=[*by, "id", "place", "reason", "relevance"])

    types = ", ".join(f"{c} {t}" for c, t in candidates.dtypes if c in by)
    return candidates.groupBy(*by).applyInPandas(run, f"{types}, id string, place int, reason string, relevance double")
