"""Texts of OCR passes put together; engines themselves are adapters that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least confidence of a box and of a text, and the characters under which another engine is asked.
LEAST_BOX_CONFIDENCE, LEAST_TEXT_CONFIDENCE, LEAST_CHARS = 0.3, 0.5, 80
SIDES = ("front", "back")


def run_engine(images: DataFrame, engine: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """(doc_id, side, pass_no, engine, text, confidence) from an OCR engine.

    `engine` gets batches of `images` and loads its model once a task; no engine
    comes with the library.
    """
    return images.mapInPandas(engine, "doc_id long, side string, pass_no int, engine string, text string, confidence double")


def confident_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes (text, confidence) that an engine is sure enough of."""
    return boxes.where(F.col("confidence") > LEAST_BOX_CONFIDENCE)


def confident_texts(tokens: DataFrame) -> DataFrame:
    """(doc_id, pass_no, confidence) of passes whose mean token probability is high enough. `tokens`: doc_id, pass_no, probability."""
    return tokens.groupBy("doc_id", "pass_no").agg(F.avg("probability").alias("confidence")).where(F.col("confidence") >= LEAST_TEXT_CONFIDENCE)


#: Pass numbers that are joined to one text first.
RUN = 256


def card_texts(passes: DataFrame) -> DataFrame:
    """(doc_id, text, n_passes, ask_again): a card's passes joined by line ends, front before back, by pass number.

    `passes`: doc_id, side, pass_no, text. Null texts count as empty, other sides
    come last. Runs of passes are joined first, each in a group of its own, so
    that of a card with very many passes only the joined runs come together, in
    the row that holds its text.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SIDES)), F.col("side")), F.lit(0).cast("long")), F.lit(9).cast("long"))
    text = F.coalesce("text", F.lit(""))
    chars = F.length(F.trim(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")
    joined = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x["text"]), "\n")
    runs = (
        passes.groupBy("doc_id", rank.alias("r"), F.floor(F.col("pass_no") / RUN).alias("run"))
        .agg(joined(F.struct("pass_no", text.alias("text"))).alias("text"), F.count("*").alias("n"), F.sum(chars).alias("chars"))
    )
    return runs.groupBy("doc_id").agg(
        joined(F.struct("r", "run", "text")).alias("text"),
        F.sum("n").cast("int").alias("n_passes"),
        (F.sum("chars") < LEAST_CHARS).alias("ask_again"),
    )


def better_reading(first: DataFrame, second: DataFrame, score: str) -> DataFrame:
    """Of two readings (doc_id, ...) of each document the one with the higher score; ties keep the first."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(-1)))
    rest = [c for c in first.columns if c != "doc_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(score, F.lit(-1.0)), F.col("__p")))
    return both.groupBy("doc_id").agg(best.alias("x")).select("doc_id", "x.*")


def retry_needed(confidence: Column, sharpness: Column) -> Column:
    """A second pass is worth it: low confidence on a blurred image."""
    return (confidence < 0.6) & (sharpness < 200)
