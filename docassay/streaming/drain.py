"""Runs a stream over all that there is, to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docassay.sources.scratch import scratch_folder
from docassay.streaming.limits import PROVIDER, ROCKSDB


def drained(spark: SparkSession, stream: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `stream()` answers to all rows that its sources have now, written down and read again.

    RocksDB keeps the state while it runs; the session's own setting is put back after.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        made = stream()
        folder = scratch_folder(spark, name)
        running = made.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")
