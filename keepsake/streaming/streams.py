"""Structured Streaming forms of the incremental parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.sources.shared import shared_path

DAY = 86_400


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event files as a stream, with a zone-free event time and its watermark."""
    schema = spark.read.parquet(path).schema
    ntz = isinstance(schema["ts"].dataType, T.TimestampNTZType)
    # a pattern, so that one file will do as well as a folder of files
    stream = spark.readStream.schema(schema).parquet(re.sub(r"([^/])(/*)$", r"[\1]\2", path))
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)" if ntz else "unix_micros(ts)"
    return stream.withColumn("at", F.expr(f"timestamp_micros({micros})")).withWatermark("at", "1 hour")


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there now; in complete mode the last batch is the result."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    write = "overwrite" if mode == "complete" else "append"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode(write).parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def day_counts(stream: DataFrame) -> DataFrame:
    """Events per day and type, updated as they come."""
    counted = stream.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select((F.unix_timestamp("window.start") / DAY).cast("long").alias("day"), "event_type", "n")


def first_keys(stream: DataFrame, key: list[str]) -> DataFrame:
    """Each idempotency key once."""
    return stream.select(*key).dropDuplicates(key)


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between neighbours."""
    counted = stream.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.unix_timestamp("session_window.start").alias("start_s"), "n")
