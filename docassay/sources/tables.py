"""Readers of the Parquet tables that every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same as a stream of its files. The name is a pattern, as Spark takes a plain path for a folder."""
    schema = read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name[:-1]}[{name[-1]}].parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it is stored in fewer pieces, for costly expressions on small rows; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
