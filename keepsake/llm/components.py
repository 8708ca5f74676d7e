"""Connected components by repeated contraction, in DataFrame operations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Distinct edges up to this number (a few MB) are joined in one task, without rounds.
ONE_TASK_EDGES = 200_000


def _union(table: pa.Table) -> pa.Table:
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = i = parent.setdefault(p, p)
        return i

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(n) for n in nodes], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node of its component.

    Each round maps every node to its smallest neighbour or itself and renames
    the edges; the graph shrinks until no edge is left, then the rounds' maps are
    composed. Edges from a node to itself make it a component of its own.
    """
    start = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if start.count() <= ONE_TASK_EDGES:
        return scratch.save(start.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_union, "node long, root long"), f"{name}-out")
    loops = start.where("a = b").select(F.col("a").alias("node"))
    now = start.where("a <> b")
    maps: list[DataFrame] = []
    while not now.isEmpty():
        k = len(maps)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low"))
        step = scratch.save(least.select("node", F.least("node", "_low").alias("root")), f"{name}-map{k}")
        left, right = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = now.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        maps.append(step)
        now = scratch.save(renamed.distinct(), f"{name}-edges{k}")
        if k:
            scratch.drop(f"{name}-edges{k - 1}")
    if not maps:
        return scratch.save(loops.select("node", F.col("node").alias("root")), f"{name}-out")
    out = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    alone = loops.join(maps[0].select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return scratch.save(out.unionByName(alone), f"{name}-out")
