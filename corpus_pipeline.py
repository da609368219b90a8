"""Training-data pipeline: five stages, each an operator of `docassay.llm` with production parameters.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame. All but the last return the columns of `docs`. Each stage works on
all rows that its predecessor kept.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm import q_language_id
from docassay.llm.classifiers import UNDETERMINED, LanguageModel, background_windows, identify_languages
from docassay.llm.common import delete_shared, shared_folder
from docassay.llm.line_dedup import drop_common_lines
from docassay.llm.mixing import mixed_documents
from docassay.llm.packing import pack
from docassay.llm.simhash import keep_one_of_similar
from docassay.sources import read_table

#: A text stays from this score on (held-out rows: README); training takes so many steps at least.
LEAST_SCORE, LEAST_STEPS = 0.4, 300


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds to be in a learnt language, with a score of LEAST_SCORE or more.

    The model also learns windows in no language; what it takes for such goes, as do
    empty texts and those without a letter. Where no language can be learnt, every
    text with a letter stays.
    """
    sample = q_language_id.sampled(docs)
    if not sample:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    model = LanguageModel.train(sample + background_windows(sample), least_steps=LEAST_STEPS)
    found = identify_languages(docs, model)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; n_chars follows the text."""
    kept = drop_common_lines(docs, min_documents=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles agree to 0.8 or more."""
    return keep_one_of_similar(docs, shingle_words=5, similarity=0.8).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL has no network, knapsack or tokenizer; tests/llm check the stages against brute force.


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents.

    Each stage's result but the last is written as Parquet to the folder in
    `spark.checkpoint.dir` and read again for the next, so that no stage is
    computed twice; the one before it is deleted then.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_shared(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
