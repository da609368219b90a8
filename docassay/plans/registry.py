"""Names of the library's queries, each with its Spark plan and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docassay.plans import audit, cards, comparisons, geo, images, ocr, submissions, verdicts, votes

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (geo, ocr, cards, comparisons, votes, verdicts, submissions, audit, images)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verdicts_by_state(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
