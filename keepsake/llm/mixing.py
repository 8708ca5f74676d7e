"""Mixing sources to target weights by iterative proportional fitting: DataFrame functions only.

Token counts are summed per cell (source x language x topic). The cells' weights
are raked to the target share of each source, then language, then topic, and
again, until all shares hold. A document's probability is its cell's raked weight
over its tokens, on one scale for all cells; the scale lets at most CLIPPED of the
weight reach past probability 1, so that a rare cell doesn't set it.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, free_prefix

#: Exponents of the natural shares in the default targets: 1 leaves them, 0 makes all values alike. Some topics are so
#: rare that a stronger one would keep little of the rest.
TEMPER, TOPIC_TEMPER = 0.6, 0.9
#: Share of the raked weight that may lie in cells whose probability would be above 1.
CLIPPED = 0.02
#: Raking ends when all shares are this close to the targets, or with an error after so many rounds.
CLOSE, ROUNDS = 1e-5, 40


class RakingError(ValueError):
    """No weights meet the targets, or not within the rounds."""


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def topic(text: Column) -> Column:
    """What kind of text it is, by its make-up: shares of character classes, and lines, of the whole text."""
    size = F.coalesce(F.length(text), F.lit(0))
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    lines = count("\\n") + 1
    return (
        F.when(size == 0, "empty")
        .when(count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]") * 50 > size, "marked up")
        .when(count(r"\p{N}") * 10 > size, "figures")
        .when((lines > 4) & (size < lines * 60), "short lines")
        .when(size > 10_000, "long form")
        .when(size < 500, "short form")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, dim: str, power: float = TEMPER) -> DataFrame:
    """Default targets: each value's share of the tokens to ``power``, made to sum to 1."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("_tokens").cast("double"), F.lit(power)).alias("_share"))
    total = sums.agg(F.sum("_share")).first()[0] or 1.0
    return sums.withColumn("_share", F.col("_share") / F.lit(total))


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE, strict: bool = True) -> tuple[DataFrame, float]:
    """(cells with ``_weight``, the residual): the shares by each dimension meet the targets up to the residual.

    The weights start as the cells' token shares. A step sums them by one
    dimension, pre-aggregated before the shuffle, and sets the cells to the targets
    that they carry; it is written before the next one, so each plan has one join
    whatever the rounds, the driver holds one small table at a time, and no window
    holds the cells of a value. Values are told apart by how they are written as strings.
    Values without tokens or without a target weigh nothing; the rest of a
    dimension's targets share their part. Targets that no weights meet are a
    RakingError, or with ``strict=False`` are met as far as the last round does.
    """
    scratch = Scratch(cells.sparkSession)
    total = cells.agg(F.sum("_tokens")).first()[0] or 1
    at = range(len(dims))
    named = cells.select("*", *[F.col(d).cast("string").alias(f"_v{i}") for i, d in enumerate(dims)], (F.col("_tokens") / F.lit(total)).alias("_weight"), F.lit(0.0).alias("_off"))
    small = []

    def matched(now: DataFrame, table: DataFrame, i: int) -> DataFrame:
        """The cells with the row of their value (``_of``) in dimension ``i``."""
        return now.join(F.broadcast(table) if small[i] else table, F.col(f"_v{i}").eqNullSafe(F.col("_of"))).drop("_of")

    for i, d in enumerate(dims):
        given = targets[d].select(F.col(d).cast("string").alias("_given"), F.col("_share").cast("double").alias("_share"))
        held = named.groupBy(F.col(f"_v{i}").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
        wanted = held.join(given, F.col("_of").eqNullSafe(F.col("_given")), "left").select("_of", F.coalesce("_share", F.lit(0.0)).alias(f"_to{i}"))
        wanted = scratch.save(wanted, f"wanted{i}")
        whole, n = wanted.agg(F.sum(f"_to{i}"), F.count(F.lit(1))).first()
        small.append(n <= BROADCAST_ROWS // 10)
        named = matched(named, wanted.withColumn(f"_to{i}", F.col(f"_to{i}") / F.lit(whole or 1.0)), i)
    last = "weights"
    named = scratch.save(named, last)

    residual = math.inf
    for r in range(rounds):
        named = named.withColumn("_off", F.lit(0.0))
        for i in at:
            held, to = F.sum("_weight"), F.max(f"_to{i}")
            step = named.groupBy(F.col(f"_v{i}").alias("_of")).agg(F.when(held > 0, to / held).otherwise(F.lit(0.0)).alias("_f"), F.abs(held - to).alias("_away"))
            now = matched(named, step, i).withColumn("_weight", F.col("_weight") * F.col("_f")).withColumn("_off", F.greatest("_off", "_away")).drop("_f", "_away")
            named = scratch.save(now, f"weights{r}_{i}")
            scratch.drop(last)
            last = f"weights{r}_{i}"
        residual = named.agg(F.max("_off")).first()[0] or 0.0  # of the shares before the round's own steps
        if residual < close:
            break
    if residual >= close and strict:
        raise RakingError(f"after {rounds} rounds a share is still {residual:.2g} off its target")
    return named.drop("_off", *[f"{c}{i}" for i in at for c in ("_v", "_to")]), residual


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))


def mix(docs: DataFrame, dims: list[str] | None = None, targets: dict[str, DataFrame] | None = None, text: str = "text", key: str = "doc_id", seed: int = 11, keep: list[str] | None = None, prefix: str = "_") -> DataFrame:
    """Every row of ``docs`` (its ``keep`` columns, all by default) with topic, tokens, probability, sampled.

    The four new names begin with ``prefix``, which no kept column may do.
    ``dims``: columns to rake besides the topic (source and lang by default).
    ``targets``: for a dimension ("topic" for the topic), a table (value,
    ``_share``); the others are tempered. Given targets that cannot be met are a
    RakingError; tempered ones (on a table where one dimension decides another)
    are met as far as possible, with a warning that tells the residual. Null values are values like any other;
    repeated rows share their key's number and so stay or go together; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = [*(dims or ["source", "lang"]), "topic"]
    axes = [*[f"{prefix}by{i}" for i in range(len(names) - 1)], f"{prefix}topic"]
    size, number, chance = f"{prefix}tokens", f"{prefix}key", f"{prefix}probability"
    rows = docs.select(
        *keep, *[F.col(d).alias(a) for a, d in zip(axes, names[:-1])], topic(F.col(text)).alias(axes[-1]), tokens(F.col(text)).alias(size), F.col(key).alias(number)
    )
    scratch = Scratch(spark)
    cells = scratch.save(rows.groupBy(*axes).agg(F.sum(size).alias("_tokens")), "cells")
    wanted = {}
    for a, d in zip(axes, names):
        given = (targets or {}).get(d)
        wanted[a] = given.select(F.col(given.columns[0]).alias(a), "_share") if given is not None else tempered(cells, a, TOPIC_TEMPER if d == "topic" else TEMPER)
    raked, residual = rake(cells, axes, wanted, strict=bool(targets))
    if residual >= CLOSE:
        warnings.warn(f"the tempered shares exclude each other: one is {residual:.2g} off", stacklevel=2)
    rate = scratch.save(raked.select(*axes, "_weight", (F.col("_weight") / F.col("_tokens")).alias("_rate")), "rates")
    frequency = F.greatest(F.lit(1), F.round(F.col("_weight") * 1e9)).cast("long")
    most = rate.where("_weight > 0").agg(F.percentile("_rate", F.lit(1 - CLIPPED), frequency)).first()[0] or 1.0
    rate = rate.select(*[F.col(a).alias(f"c{a}") for a in axes], F.least(F.lit(1.0), F.col("_rate") / F.lit(most)).alias(chance))
    if rate.count() <= BROADCAST_ROWS // 10:
        rate = F.broadcast(rate)
    on = reduce(lambda a, b: a & b, [rows[a].eqNullSafe(rate[f"c{a}"]) for a in axes])
    out = rows.join(rate, on, "left").drop(*[f"c{a}" for a in axes])
    return out.withColumn(f"{prefix}sampled", uniform(number, seed) < F.col(chance)).drop(number, *axes[:-1])


def sample(docs: DataFrame, dims: list[str] | None = None, targets: dict[str, DataFrame] | None = None, text: str = "text", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """The sampled rows of ``docs``, with the columns they came with."""
    prefix = free_prefix(docs)
    return mix(docs, dims, targets, text, key, seed, None, prefix).where(F.col(f"{prefix}sampled")).select(*docs.columns)
