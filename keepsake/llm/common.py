"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows, that is broadcast after its size was counted.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only in local mode, where they are one process, is one made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keepsake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors; they go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/keepsake-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and read it back with its schema."""
        out = df.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what Python makes of the texts is small too."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def trim() -> None:
    """Gives memory that a task has freed back to the system: idle Python workers count as their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_caches: dict[str, dict] = {}


def worker_cache(name: str, cache: dict, most: int) -> dict:
    """``cache``, emptied if it holds over ``most`` entries; the caches of other operators are emptied.

    Python workers are reused from task to task, so without this a pipeline's
    worker would hold the words of all its stages.
    """
    for other, held in _caches.items():
        if other != name:
            held.clear()
    if name not in _caches:
        _caches.clear()
        _caches[name] = cache
        trim()
    if len(cache) > most:
        cache.clear()
    return cache


#: The columns of documents that the classifier's metadata view reads.
META = ["source", "lang", "n_chars"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with (names clash without regard to case)."""
    prefix = "__k"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix + "_"


def dense_ranks(df: DataFrame, order: list[str], ties: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Adds ``out``: exact row numbers from 0 by ``order`` then any order, without a global sort.

    ``order``: columns with boundedly many distinct values (a curve cell, a
    length; nulls allowed). Rows of one key are dealt to sub-buckets by the hash
    of ``ties``, in proportion to the key's rows: a key with a third of all rows
    gets about ``parts / 3`` windows. ``parts`` grows with the rows (20,000 each)
    from 8,192 to 131,072; the offsets table has at most ``parts`` plus twice the
    number of keys rows, which bounds its broadcast at any input size.
    Rows equal in ``ties`` are numbered among themselves in any order.
    ``df`` is read three times: pass a stored table.
    """
    from pyspark.sql import Window

    total = max(1, df.count())
    parts = parts or min(131_072, max(8_192, total // 20_000))
    on = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    keys = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    keys = keys.select(*order, F.ceil(F.col("_n") * F.lit(parts) / F.lit(total)).cast("long").alias("_subs"))
    dealt = df.alias("d").join(F.broadcast(keys).alias("k"), on("d", "k", order), "left").select(
        "d.*", F.pmod(F.xxhash64(*[F.col(f"d.{c}") for c in ties]), F.col("k._subs")).alias("_sub")
    )
    counts = dealt.groupBy(*order, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.groupBy(*order).agg(F.sum("_n").alias("_key"))
    before = sums.select(*order, (F.sum("_key").over(Window.orderBy(*order)) - F.col("_key")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(*order).orderBy("_sub")) - F.col("_n")
    offsets = counts.withColumn("_inside", inside).alias("c").join(
        F.broadcast(before).alias("b"), on("c", "b", order)
    ).select(*[f"c.{c}" for c in order], "c._sub", (F.col("b._before") + F.col("c._inside")).alias("_offset"))
    number = F.row_number().over(Window.partitionBy(*order, "_sub").orderBy(*ties))
    placed = dealt.withColumn("_number", number).alias("p").join(
        F.broadcast(offsets).alias("o"), on("p", "o", [*order, "_sub"])
    )
    return placed.select("p.*", (F.col("o._offset") + F.col("p._number") - 1).alias(out)).drop("_sub", "_number")
