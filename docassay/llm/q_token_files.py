"""op13: all documents as files of packed token ids, and what is read back from them."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.common import shared_folder
from docassay.llm.token_files import read_token_ids, write_token_ids
from docassay.sources import read_table

NAME = "op13_token_files"
SQL = None  # SQL has no tokenizer; tests/llm check the round trip against `tokenizers`.


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in this application's folder under `spark.checkpoint.dir`, as the result is read from them."""
    path = f"{shared_folder(spark)}/token-ids-{uuid4().hex}"
    write_token_ids(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
