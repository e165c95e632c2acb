"""Streams: latest state of an append-only log, and idempotent sinks for micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.storage import upsert


def file_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def latest_in_stream(log: DataFrame, key: str, value: str, time: str, late: str = "30 days") -> DataFrame:
    """(key, value, time) of the latest row of each key, kept up to date; ties: the greatest value. Rows later than
    ``late`` behind the newest are dropped with their state."""
    timed = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(key).agg(F.max(F.struct(time, value)).alias("r")).select(key, F.col(f"r.{value}").alias(value), F.col(f"r.{time}").alias(time))


def windowed_counts(log: DataFrame, time: str, key: str, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window start, key, n) of tumbling windows, closed once the watermark has passed."""
    timed = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def upsert_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key by ``order`` over all batches: a batch that is sent
    again and a row that comes in a later batch than a newer one change nothing. Read the table with read_table."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, path, batch, keys, order)

    return write
