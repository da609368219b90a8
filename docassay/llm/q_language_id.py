"""op5: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.classifiers import LanguageModel, identify_languages, labelled_sample, remainder
from docassay.sources import read_table

NAME = "op5_language_id"
SQL = None  # A trained model; tests/llm check its accuracy on held-out rows.


def sampled(docs: DataFrame) -> list[tuple[object, list[bytes]]]:
    """Windows of the documents whose remainder is not 2, by lang."""
    learnt_from = docs.where(remainder("doc_id", 4) != 2)
    labels = learnt_from.select("doc_id", F.col("lang").alias("label"))
    return labelled_sample(labels, learnt_from.select("doc_id", "text"), seed=3)


def learn(docs: DataFrame) -> LanguageModel:
    """From text and lang of the documents whose remainder is not 2."""
    return LanguageModel.train(sampled(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs.select("doc_id", "text"), learn(docs))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
