"""int8 codes of vectors and their products, as columns and in blocks."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale(vector: Column) -> Column:
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))) / 127
    return F.when(top > 0, top).otherwise(1.0)


def codes(vector: Column, by: Column) -> Column:
    """Rounded half away from zero; at most 127 in magnitude. A null component has no code.

    ``by`` must not be a column that the same select gives a new value: inside a lambda Spark takes that value.
    """
    return F.transform(vector, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / by).cast("int")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)


def pack(q: Column) -> Column:
    """Codes as one byte each, in two's complement."""
    return F.unhex(F.array_join(F.transform(q, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(255)), 2, "0")), ""))


def unpack(q: Column) -> Column:
    """The codes of packed bytes; no bytes give no codes."""
    byte = lambda i: F.conv(F.hex(F.substring(q, i + 1, F.lit(1))), 16, 10).cast("int")
    signed = lambda i: F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i))
    return F.when(F.length(q) > 0, F.transform(F.sequence(F.lit(0), F.length(q) - 1), signed)).when(q.isNotNull(), F.array().cast("array<int>"))


#: Rows of one block of a scope.
BLOCK = 2_000


def top_neighbours(vectors: DataFrame, k: int = 16, by: list[str] | None = None) -> DataFrame:
    """(by, id, rank, neighbour, relevance): the k nearest others of every vector within its scope.

    Scopes are cut into blocks; each pair of blocks is one task's matrix product
    of int8 codes, which returns k rows a probe, and the partial lists are merged.
    Ties go to the smaller id, before truncation.
    """
    by = by or ["namespace"]
    coded = vectors.withColumn("scale", scale(F.col("embedding"))).select(*by, "id", "scale", codes(F.col("embedding"), F.col("scale")).alias("q"))
    sizes = coded.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = coded.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    probes = rows.select(*by, F.col("block").alias("a"), F.explode(every).alias("b"), "id", "scale", "q", F.lit(True).alias("probe"))
    others = rows.select(*by, F.explode(every).alias("a"), F.col("block").alias("b"), "id", "scale", "q", F.lit(False).alias("probe"))

    def nearest(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        probe = table.column("probe").to_numpy()
        ids, s = np.array(table.column("id").to_pylist(), object), table.column("scale").to_numpy()
        q = np.array(table.column("q").to_pylist(), np.float64)  # exact: products of int8 stay far below 2**53
        a, b = np.flatnonzero(probe), np.flatnonzero(~probe)
        out: list[tuple] = []
        for i in range(0, len(a), 512):
            own = a[i : i + 512]
            score = (q[own] @ q[b].T) * s[own][:, None] * s[b][None, :]
            score[ids[own][:, None] == ids[b][None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            for r, p in enumerate(own):
                out += [(ids[p], ids[b[c]], float(score[r, c])) for c in best[r] if np.isfinite(score[r, c])]
        cols = list(zip(*out)) if out else [[], [], []]
        scope = {c: pa.array([table.column(c)[0].as_py()] * len(out), table.schema.field(c).type) for c in by}
        return pa.table({**scope, "id": pa.array(cols[0], pa.string()), "neighbour": pa.array(cols[1], pa.string()), "relevance": pa.array(cols[2], pa.float64())})

    types = ", ".join(f"{c} {t}" for c, t in vectors.dtypes if c in by)
    from pyspark.sql import Window

    found = probes.unionByName(others).groupBy(*by, "a", "b").applyInArrow(nearest, f"{types}, id string, neighbour string, relevance double")
    order = Window.partitionBy(*by, "id").orderBy(F.desc(F.round("relevance", 9)), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
