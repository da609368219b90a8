"""op8: all documents mixed by source weights 3, 1, 2 to 150 % of their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docassay.llm.mixing import mix
from docassay.sources import read_table

NAME = "op8_mixing"
SQL = None  # The knapsack is no SQL; tests/llm hold targets and sums against brute force.


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
