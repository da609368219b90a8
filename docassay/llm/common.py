"""What several operators share: checkpoints, pieces of Arrow batches, stable hashes, byte columns."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Bytes that a task works on at a time. Spark bounds its Arrow batches to 64 MB; what is made of one can be far larger.
PIECE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under `spark.checkpoint.dir`, on storage that the driver and all executors share.

    Without that setting a temporary folder takes its place in local mode, where
    one process does everything; on a cluster it is an error, as no folder is
    known to be shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and cut from its lineage; a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame, path: str) -> DataFrame:
    """`df` written as Parquet to `path` in the shared folder and read again.

    For loops: a checkpoint keeps the size that the optimizer guessed for its
    plan, and guesses of joins over joins grow to numbers of a million digits.
    A table's size is that of its files.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_shared(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in batches of at most `most` bytes or of one row."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def spans(sizes: Iterable[int], most: int = PIECE_BYTES) -> list[slice]:
    """Slices of a list with the given sizes, each of `most` in sum or of one item at least."""
    ends = np.cumsum(np.fromiter(sizes, np.int64))
    out, at = [], 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        out.append(slice(at, to))
        at = to
    return out


def seeded_long(seed: int, *columns: Column | str) -> Column:
    """A 64-bit hash of the columns that differs from seed to seed."""
    return F.xxhash64(F.lit(seed), *columns)


def utf8(text: Column | str) -> Column:
    """The text's bytes, for Arrow without decoding; null stays null."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")
