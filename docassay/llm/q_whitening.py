"""op12: embeddings whitened by their first 16 principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docassay.llm.whitening import whiten, whole_numbers
from docassay.sources import read_table

NAME = "op12_embedding_whitening"
SQL = None  # SQL has no eigenvectors; tests/llm hold the result against numpy's.


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read_table(spark, sf_dir, "embeddings")
    return whiten(embeddings.select("vec_id", whole_numbers("embedding", 64, 1_000_000).alias("vector")), most=16)
