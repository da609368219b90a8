"""op10: all documents packed into sequences of 1024 token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docassay.llm.packing import pack
from docassay.sources import read_table

NAME = "op10_packing"
SQL = None  # SQL has no tokenizer; tests/llm check the round trip against `tokenizers`.


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(read_table(spark, sf_dir, "documents"), path, length=1024)
