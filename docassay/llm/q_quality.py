"""op2: the quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.classifiers import QualityModel, labelled_sample, remainder, score_quality
from docassay.sources import read_table

NAME = "op2_quality_classifier"
SQL = None  # A trained model; tests/llm check its accuracy on held-out rows.
SAMPLE_DOCS = 1000


def learn(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """From the labelled documents whose remainder is not 1."""
    labelled = labels.where((remainder("doc_id", 3) != 1) & F.col("quality").isin(0, 1)).select(
        "doc_id", F.col("quality").alias("label")
    )
    sample = labelled_sample(labelled, docs.select("doc_id", "text"), seed=4, docs_per_label=SAMPLE_DOCS)
    share = labelled.agg(F.avg("label")).first()[0]
    return QualityModel.train(sample, share=share)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = score_quality(docs.select("doc_id", "text"), learn(docs, read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
