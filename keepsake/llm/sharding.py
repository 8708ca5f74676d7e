"""Hilbert-curve sharding: DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, the cells are put
in the order of a Hilbert curve, and the curve is cut into runs of equal row
counts. Files of neighbouring rows then cover small boxes in every dimension, so
readers prune them by the minima and maxima of any of these columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, dense_ranks

#: Bytes counted for each row besides its text.
ROW_BYTES = 16


def ordinal(df: DataFrame, name: str) -> Column:
    """A long that keeps the column's order: numbers as they are, strings by their first seven bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        prefix = F.rpad(F.hex(F.substring(F.encode(F.col(name), "utf-8"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(prefix, 16, 10).cast("long"), F.lit(-1))
    return F.coalesce(F.col(name).cast("long"), F.lit(-1))


def quantise(df: DataFrame, names: list[str], bits: int) -> DataFrame:
    """Replaces each named long column by its quantile bin, 0 to 2**bits - 1."""
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(c, cuts, 10_000).alias(c) for c in names]).first()
    bins = {c: reduce(lambda a, b: a + b, [(F.col(c) > v).cast("int") for v in found[c] or []], F.lit(0)) for c in names}
    return df.withColumns(bins)


def hilbert_number(point: list[int], bits: int) -> int:
    """The index of one cell on the Hilbert curve (Skilling's transform, AIP Conf. Proc. 707, 2004)."""
    x, top = list(point), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = 0, top
    while q > 1:
        turn ^= (q - 1) * bool(x[-1] & q)
        q >>= 1
    index = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            index = index * 2 + (((v ^ turn) >> bit) & 1)
    return index


def hilbert_index(names: list[str], bits: int) -> Column:
    """The Hilbert index of bin columns: a lookup in the curve's table of cells.

    The table has 2 ** (bits * dimensions) entries whatever the input's size; it
    is one constant of the plan, so the lookup stays in generated code.
    """
    from itertools import product

    cells = product(range(1 << bits), repeat=len(names))
    curve = ",".join(str(hilbert_number(list(c), bits)) for c in cells)
    cell = reduce(lambda a, b: a * (1 << bits) + b, [F.col(c).cast("int") for c in names])
    return F.get(F.split(F.lit(curve), ","), cell).cast("long")


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int = 40, bits: int = 4, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns (all but the text by default), ``size``, ``text_crc32``, ``curve``, ``shard``, ``slot``.

    ``dims`` names columns of ``docs``; ``size`` (UTF-8 bytes of the text plus
    16) is always one more dimension. Shards are runs of the curve whose row
    counts differ by one at most; ``slot`` is gapless from 0 in each.

    Null texts count no bytes and have the digest of the empty text; null
    dimensions sort first; repeated rows are rows of their own; an empty table
    gives no rows; other columns of the input whose names clash with those
    added are left out.
    """
    made = {"size", "text_crc32", "curve", "shard", "slot"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c.lower() not in made and not c.startswith("_")]
    body = F.coalesce(F.col(text), F.lit(""))
    staged = docs.select(
        *dict.fromkeys([key, *keep]),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        *[ordinal(docs, c).alias(f"_d{i}") for i, c in enumerate(dims)],
    )
    scratch = Scratch(docs.sparkSession)
    # the only pass over the texts; what follows works on a few bytes a row
    staged = scratch.save(staged.withColumn(f"_d{len(dims)}", F.col("size")), "staged")
    axes = [f"_d{i}" for i in range(len(dims) + 1)]
    curve = quantise(staged, axes, bits).withColumn("curve", hilbert_index(axes, bits)).drop(*axes)
    ranked = dense_ranks(curve, ["curve"], [key, "text_crc32", "size"], "_rank")
    total = staged.count()
    less, more = total // shards, total % shards
    rank, edge = F.col("_rank"), more * (less + 1)
    first = rank < edge
    rest = rank - edge
    return ranked.withColumns({
        "shard": F.when(first, F.floor(rank / (less + 1))).otherwise(more + F.floor(rest / max(1, less))).cast("int"),
        "slot": F.when(first, rank % (less + 1)).otherwise(rest % max(1, less)).cast("long"),
    }).drop("_rank")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes ``docs`` in one folder per shard, each sorted by slot (``key`` unique)."""
    at = placed.select(F.col(key).alias("_key"), "shard", "slot")
    docs.join(at, docs[key] == at["_key"]).drop("_key").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
