"""Submissions as a stream: admitted by key and content, and written to the audit log once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docassay.operators.audit import admission, authorised


def admitted(submissions: DataFrame, keys: DataFrame, quality: Column, duplicate: Column | None = None, failed: Column | None = None) -> DataFrame:
    """`submissions` (api_key, has_front, ...; a stream or a table) with status, the first gate's that refuses, or 200.

    `keys` (api_key) is a table: it is read anew for every batch of a stream.
    """
    known = authorised(submissions, keys)
    no = F.lit(False)
    status = admission(F.col("auth_status"), F.lit(True), F.coalesce("has_front", no), quality, no if duplicate is None else duplicate, failed)
    kept = [c for c in submissions.columns if c != "status"]
    return known.select(*kept, status.cast("int").alias("status"))


def log_stream(entries: DataFrame, log_path: str, checkpoint: str, source: str = "intake") -> StreamingQuery:
    """Starts a query that writes each batch of the stream `entries` to the audit log, and ends when all there is is written.

    A batch has a folder of its own in the log, by the number that Spark's
    checkpoint gives it, and replaces what is in it: if a job dies after writing and
    before the checkpoint knows, the restarted one writes the same batch to the
    same place, and every entry stands in the log once. Streams with checkpoints of
    their own need a `source` of their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{log_path}/source={source}/batch={batch_id}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
