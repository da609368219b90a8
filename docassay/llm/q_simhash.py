"""op9: SimHash components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docassay.llm.simhash import hex16, near_duplicates
from docassay.sources import read_table

NAME = "op9_simhash_near_dedup"
SQL = None  # DuckDB has no XXH64 with a seed; tests/llm compare with brute force.


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3, radius=2)
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
