"""Bulk-synchronous best-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so documents sorted by length, and
gaps sorted by size, are runs of equal ones: a run is a length, a first rank and a
count. Documents are dealt into ranges of lengths. Each superstep takes one range,
longest first: its runs and all gaps are cut by rank into parts, and one task a
part sweeps through them, giving each document its successor, the smallest gap of
the part that holds it. Documents that want gaps of other parts are then told
apart by rank, what no gap holds opens sequences, the gaps are updated and written,
and the next superstep starts from them. The tables of runs are bounded by
capacity, parts and supersteps, whatever the number of documents; nothing but the
final runs is on the driver, and ranks are dealt out on the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense_ranks, slices
from .tokens import WordEncoder

CAPACITY = 2048
#: Parts that runs are cut into in a superstep.
PARTS = 8

Run = tuple[int, int, int]
Placed = tuple[int, int, int, int, int]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Cuts each document's ids (and a closing id 0) into pieces of at most ``capacity``.

    Null and empty texts give one piece: the closing id. ``ids=True`` adds the
    packed little-endian 32-bit ids of each piece.
    """
    from pyspark.sql import types as T

    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * ids

    def cut(batches):
        encoder, step = WordEncoder.of(tokenizer), 4 * capacity
        for batch in slices(batches):
            texts = [t.encode("utf-8") if t else b"" for t in batch.column(1).to_pylist()]
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, packed in enumerate(encoder.ids(texts)):
                packed += b"\0\0\0\0"
                for k in range(0, len(packed), step):
                    part = packed[k : k + step]
                    row.append(i)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        raw.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(raw, pa.binary())] * ids], [f.name for f in fields])

    return docs.select(key, text).mapInArrow(cut, T.StructType(fields))


def sweep(docs: list[Run], gaps: list[tuple[int, int, int]], capacity: int) -> tuple[list[Placed], list[Run], list[tuple[int, int, int]]]:
    """One successor sweep over runs, longest documents first.

    ``docs``: (length, first rank, documents); ``gaps``: (size, first sequence,
    sequences). Each document takes its successor, the smallest gap that holds
    it; a gap takes as many of a length as it holds. Returns the placements, the
    documents without a successor, and the gaps as they are now.
    """
    held: dict[int, list[tuple[int, int]]] = {}
    for size, first, k in sorted(gaps, reverse=True):
        held.setdefault(size, []).append((first, k))
    sizes, placed, left = sorted(held), [], []

    def shrunk(size: int, first: int, k: int) -> None:
        if size:
            if size not in held:
                insort(sizes, size)
            held.setdefault(size, []).append((first, k))

    for n, rank, k in sorted(docs, key=lambda d: (-d[0], d[1])):
        while k and (at := bisect_left(sizes, n)) < len(sizes):
            size = sizes[at]
            first, m = held[size].pop()
            each = min(k, size // n)
            take = min(m, k // each)
            for i in range(each):
                placed.append((n, rank + i * take, take, first, capacity - size + i * n))
            rank, k = rank + each * take, k - each * take
            if take < m:
                held[size].append((first + take, m - take))
            if not held[size]:
                del held[size], sizes[at]
            shrunk(size - each * n, first, take)
        if k:
            left.append((n, rank, k))
    return placed, left, [(size, first, k) for size in sizes for first, k in held[size]]


def settle(docs: list[Run], gaps: list[tuple[int, int, int]], capacity: int, fresh: int) -> tuple[list[Placed], list[tuple[int, int, int]]]:
    """What the parts have left over: by rank, into any gap; what no gap holds opens sequences, numbered from ``fresh``.

    As many are opened at once as the documents left fill at least; the longest
    open them and the others are swept again.
    """
    placed, left, gaps = sweep(docs, gaps, capacity)
    while left:
        need = -(-sum(n * k for n, _, k in left) // capacity)
        rest = []
        for n, rank, k in left:  # longest first
            take = min(need, k)
            if take:
                placed.append((n, rank, take, fresh, 0))
                if n < capacity:
                    gaps.append((capacity - n, fresh, take))
                fresh, need = fresh + take, need - take
            if take < k:
                rest.append((n, rank + take, k - take))
        more, left, gaps = sweep(rest, gaps, capacity)
        placed += more
    return placed, gaps


def bands(capacity: int) -> list[tuple[int, int]]:
    """Ranges of lengths (above, up to), longest first: one superstep each."""
    # up to 4 documents a sequence each range has one number of them, which keeps the sweeps near a sweep by single lengths
    edges = [capacity, *[capacity // d for d in (2, 3, 4, 8, 32) if capacity // d], 0]
    return list(zip(edges[1:], edges))


_RUN = "kind string, length int, first long, k long, at long, offset int"


def _rows(placed: list[Placed], docs: list[Run], gaps: list[tuple[int, int, int]]) -> pa.Table:
    """kind p: documents of ``length`` from rank ``first`` on are in sequences from ``at`` on; d: documents without a place; g: gaps."""
    rows = [("p", n, rank, k, at, offset) for n, rank, k, at, offset in placed]
    rows += [("d", n, rank, k, None, None) for n, rank, k in docs] + [("g", size, first, k, None, None) for size, first, k in gaps]
    names, types = zip(*[x.split() for x in _RUN.split(", ")])
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({c: pa.array(v, kinds[t]) for c, v, t in zip(names, columns, types)})


def _runs(table: pa.Table, kind: str) -> list[tuple]:
    part = table.filter(pa.compute.equal(table.column("kind"), kind))
    return list(zip(*[part.column(c).to_pylist() for c in ("length", "first", "k")]))


def best_fit(lengths: DataFrame, scratch: Scratch, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """(length, first, k, at, offset): documents of ``length`` ranked from ``first`` on lie in sequences ``at``, ``at`` + 1, ... at ``offset``.

    ``lengths``: length, n. A superstep takes one range of lengths. All runs, of
    documents and of gaps, are cut by rank into ``parts``, which are swept side by
    side; what two parts would contend for is settled by rank, the gaps are
    written, and the next range follows.
    """
    start = lengths.select(F.lit("d").alias("kind"), F.col("length").cast("int").alias("length"), F.lit(0).cast("long").alias("first"), F.col("n").alias("k"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("offset"))
    gaps, written = start.limit(0), []

    def part_sweep(table: pa.Table) -> pa.Table:
        return _rows(*sweep(_runs(table, "d"), _runs(table, "g"), capacity))

    def settled(step: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            placed, left = settle(_runs(table, "d"), _runs(table, "g"), capacity, step << 40)
            return _rows(placed, [], left)

        return run

    for step, (above, upto) in enumerate(bands(capacity)):
        todo = start.where(F.col("length").between(above + 1, upto)).unionByName(gaps)
        cut = todo.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        low = lambda p: F.floor(F.col("k") * p / parts).cast("long")
        cut = cut.withColumn("_low", low(F.col("part"))).withColumn("_k", low(F.col("part") + 1) - F.col("_low")).where("_k > 0")
        cut = cut.select("part", "kind", "length", (F.col("first") + F.col("_low")).alias("first"), F.col("_k").alias("k"), "at", "offset")
        swept = scratch.save(cut.groupBy("part").applyInArrow(part_sweep, _RUN), f"swept{step}")

        # runs, bounded by lengths, parts and supersteps; their number doesn't grow with the documents
        rest = swept.where("kind <> 'p'").withColumn("_all", F.lit(0)).groupBy("_all")
        state = scratch.save(rest.applyInArrow(settled(step), _RUN), f"settled{step}")
        gaps = state.where("kind = 'g'")
        written += [f"{scratch.root}/swept{step}", f"{scratch.root}/settled{step}"]
    return lengths.sparkSession.read.schema(state.schema).parquet(*written).where("kind = 'p'").drop("kind")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``capacity`` are cut; every sequence is filled
    gapless from 0. Repeated keys are documents of their own; an empty table
    gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.save(pieces(docs, tokenizer, capacity, text, key), "pieces")  # the only pass over the texts
    lengths = scratch.save(cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in lengths.collect()}  # capacity rows at most
    runs = best_fit(lengths, scratch, capacity).collect()  # as many rows as runs
    base = dict(zip(sorted(counts), np.cumsum([0, *[counts[n] for n in sorted(counts)]]).tolist()))
    table = np.array(sorted((base[r.length] + r["first"], r["at"], r.offset) for r in runs), np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast(table)
    ranked = dense_ranks(cut, ["length"], [key, "piece", "ids_crc32"], "_rank")
    kind = dict(cut.dtypes)[key]

    def assign(batches):
        starts, first, offset = shared.value.T
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(starts, rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (key, "piece", "start")], batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), pa.array(first[at] + rank - starts[at]), pa.array(offset[at])],
                [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(assign, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
