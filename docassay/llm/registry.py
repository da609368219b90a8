"""Queries op1 to op13 over the given tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docassay.llm import (
    q_conversations,
    q_language_id,
    q_line_dedup,
    q_maxscore,
    q_merkle,
    q_mixing,
    q_packing,
    q_quality,
    q_sharding,
    q_simhash,
    q_token_files,
    q_url_filter,
    q_whitening,
)

MODULES = [
    q_maxscore,
    q_quality,
    q_sharding,
    q_merkle,
    q_language_id,
    q_url_filter,
    q_line_dedup,
    q_mixing,
    q_simhash,
    q_packing,
    q_conversations,
    q_whitening,
    q_token_files,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if m.SQL is not None}
