"""Dropping lines that many documents share.

Lines are exploded with their position and a 128-bit hash of their key (the
line without ASCII white space at its ends, A-Z in lower case). Distinct
documents are counted per hash; positions of lines over the threshold come back
to their document, which is put together again from the other positions.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.llm.common import ASCII_SPACE, pieces, shared_checkpoint, utf8

_STRIP = ASCII_SPACE.encode()


def line_keys(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(position, key hash) of each line whose key has `min_chars` code points."""
    out = []
    for at, line in enumerate((text or b"").split(b"\n")):
        key = line.strip(_STRIP).lower()
        # code points: the bytes that do not continue a UTF-8 sequence
        if len(key) >= min_chars and (
            min_chars <= 1 and key or sum(b & 0xC0 != 0x80 for b in key) >= min_chars
        ):
            out.append((at, xxhash.xxh3_128_digest(key)))
    return out


def exploded_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and __h (the row), counted (document to count), pos, key: a row per line with a key."""
    id_field = docs.schema["doc_id"]

    def explode(batches):
        for batch in pieces(batches):
            row, pos, key = [], [], []
            for n, text in enumerate(batch.column(3)):
                for at, k in line_keys(text.as_py(), min_chars):
                    row.append(n)
                    pos.append(at)
                    key.append(k)
            of_row = batch.select([0, 1, 2]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*of_row.columns, pa.array(pos, pa.int32()), pa.array(key, pa.binary())],
                names=["doc_id", "__h", "counted", "pos", "key"],
            )

    return docs.select("doc_id", "__h", "__counted", utf8("text")).mapInArrow(
        explode, f"doc_id {id_field.dataType.simpleString()}, __h long, counted long, pos int, key binary"
    )


_KEPT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
)


@F.pandas_udf(_KEPT)
def _without(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    kept, n_lines, n_dropped = [], [], []
    for t, drop in zip(text, dropped):
        lines = (t or "").split("\n")
        n_lines.append(len(lines))
        if drop is None:
            kept.append(t)
            n_dropped.append(0)
            continue
        out = set(drop.tolist())
        kept.append("\n".join(x for at, x in enumerate(lines) if at not in out))
        n_dropped.append(len(out))
    return pd.DataFrame({"text": kept, "n_lines": n_lines, "n_dropped": n_dropped})


def drop_common_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` with the lines left out whose key is in `min_documents` documents.

    Adds n_lines (before dropping) and n_dropped, in place of columns of that
    name; other columns stay. Documents are counted by doc_id; rows without one
    count by their text. A null or empty text is one empty line and stays as it
    is; a key shorter than `min_chars` code points (empty keys always) is never
    dropped. A text that loses all lines becomes empty. Repeated rows get the
    same result each, and count once. A row is known by its doc_id and a 64-bit
    hash of its text, so only rows that share an id could be mistaken for each other.
    """
    base = docs.drop("n_lines", "n_dropped")
    hashed = F.xxhash64("text")
    keyed = base.withColumns({"__h": hashed, "__counted": F.coalesce(F.col("doc_id"), hashed)})
    # both written down: lines are cut once, and the join below has shuffles of its own whose hot keys Spark can split
    lines = shared_checkpoint(exploded_lines(keyed, min_chars))
    common = shared_checkpoint(
        lines.groupBy("key")
        .agg(F.countDistinct("counted").alias("documents"))
        .where(F.col("documents") >= min_documents)
        .select("key")
    )
    dropped = (
        lines.select("doc_id", "__h", "pos", "key")
        .join(common, "key", "left_semi")
        .groupBy(F.col("doc_id").alias("__id"), F.col("__h").alias("__text"))
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    joined = keyed.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__text")), "left")
    out = joined.withColumn("__out", _without("text", "__dropped"))
    return out.select(
        *(F.col("__out.text").alias(c) if c == "text" else F.col(c) for c in base.columns),
        "__out.n_lines",
        "__out.n_dropped",
    )
