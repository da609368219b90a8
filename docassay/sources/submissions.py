"""Uploaded card images in a drop folder: one file a side, named <submission>_<side>.<extension>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.sources.images import EXTENSIONS

# Sides of a submission.
SIDES = ("front", "back", "selfie")
_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _sides(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parts = rf"(?i)^(.+)_({'|'.join(SIDES)})\.(?:{'|'.join(EXTENSIONS)})$"
    return files.select(
        F.regexp_extract(name, parts, 1).alias("submission_id"), F.lower(F.regexp_extract(name, parts, 2)).alias("side"),
        F.col("modificationTime").alias("received"), F.col("content").alias("data"),
    ).where("submission_id <> ''")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """submission_id, side, received, data for every side under `path`; files of other names are left out."""
    return _sides(spark.read.format("binaryFile").load(path))


def stream_submissions(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: every file that comes to `path`, once."""
    return _sides(spark.readStream.format("binaryFile").schema(_SCHEMA).load(path))


def complete(sides: DataFrame) -> DataFrame:
    """(submission_id, has_front, has_back, has_selfie): a submission without a front is refused."""
    return sides.groupBy("submission_id").agg(*(F.max(F.col("side") == s).alias(f"has_{s}") for s in SIDES))
