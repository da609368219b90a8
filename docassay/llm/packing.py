"""Bounded-space online packing of documents into token sequences.

Every partition keeps a fixed number of open windows. A document's ids (with a
closing id) fill whole sequences first; what is left is placed best-fit: into
the fullest window that has room. When none has, the fullest is emitted, after
it is topped up by a cut of the new piece if more than `max_pad` places would
stay empty. The windows that stay open at the end are merged between partitions,
`FAN_IN` at a time, by the same rule; the last merge cuts freely, so that one
sequence at most stays short. Memory is bounded by the open windows and one
document.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import pieces, shared_checkpoint, utf8
from docassay.sources import spread
from docassay.llm.tokens import byte_bpe

FAN_IN = 8
CLOSING_ID = b"\0\0\0\0"
#: Sequence ids: merge level, then partition or group, then a running number.
LEVEL_BITS, GROUP_BITS = 56, 28
#: Numbers of rows: partition, then a running number.
ROW_BITS = 33


class Packer:
    """The open windows of one partition; `rows` gets a tuple for each piece placed."""

    def __init__(self, length: int, windows: int, max_pad: int, keep_ids: bool):
        self.length, self.windows, self.max_pad, self.keep_ids = length, windows, max_pad, keep_ids
        self.open: list[list] = []  # [used, [(doc_id, row, start, ids, doc_tokens), ...]]
        self.rows: list[tuple] = []
        self.next_id = 0

    def emit(self, window: list, closed: bool = True) -> None:
        at = 0
        for doc_id, row, start, ids, doc_tokens in window[1]:
            n = len(ids) // 4
            kept = ids if self.keep_ids or not closed else None
            self.rows.append((doc_id, row, start, n, zlib.crc32(ids), doc_tokens, self.next_id, at, closed, kept))
            at += n
        self.next_id += 1

    def place(self, doc_id, row: int, start: int, ids: bytes, doc_tokens: int) -> None:
        length = self.length
        while len(ids) >= 4 * length:
            self.emit([length, [(doc_id, row, start, ids[: 4 * length], doc_tokens)]])
            start, ids = start + length, ids[4 * length :]
        while ids:
            n = len(ids) // 4
            best = None
            for w in self.open:
                if w[0] + n <= length and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[0] += n
                best[1].append((doc_id, row, start, ids, doc_tokens))
                if best[0] == length:
                    self.open.remove(best)
                    self.emit(best)
                return
            fullest = max(self.open, key=lambda w: w[0])
            room = length - fullest[0]
            if room > self.max_pad:
                fullest[1].append((doc_id, row, start, ids[: 4 * room], doc_tokens))
                start, ids = start + room, ids[4 * room :]
            self.open.remove(fullest)
            self.emit(fullest)

    def finish(self, closed: bool) -> None:
        for w in self.open:
            self.emit(w, closed)
        self.open = []

    def table(self, schema: pa.Schema, level: int, group: int) -> pa.Table:
        base = (level << LEVEL_BITS) + (group << GROUP_BITS)
        columns = list(zip(*self.rows)) or [()] * 10
        columns[6] = [base + k for k in columns[6]]
        self.rows = []
        arrays = [pa.array(c, f.type) for c, f in zip([*columns, [group] * len(columns[0])], schema)]
        return pa.Table.from_arrays(arrays, schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    kinds = [("doc_id", id_type), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    return pa.schema([*kinds, ("closed", pa.bool_()), ("ids", pa.binary()), ("part", pa.int64())])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 1024,
    windows: int = 16,
    max_pad: int = 8,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row (and ids).

    Every id of every row of `docs` lies in exactly one piece, every sequence
    has `length` ids at most, and its pieces follow each other from offset 0.
    A null or empty text has only the closing id 0. Rows are packed one by one,
    so repeated rows or ids are packed as often as they occur, and `row`, a number
    of its own for every row of `docs`, tells their pieces apart; a null doc_id
    stays null. Other columns are not read. An empty table gives no pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_field = docs.schema["doc_id"]
    schema = _schema(to_arrow_type(id_field.dataType))
    ddl = f"doc_id {id_field.dataType.simpleString()}, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed boolean, ids binary, part long"

    def first(batches):
        encode = byte_bpe(tokenizer_path).all_ids
        part = TaskContext.get().partitionId()
        packer, row = Packer(length, windows, max_pad, with_ids), part << ROW_BITS
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode((text.as_py() or b"").decode("utf-8", "replace")) + CLOSING_ID
                packer.place(doc_id, row, 0, ids, len(ids) // 4)
                row += 1
            yield from packer.table(schema, 0, part).to_batches()
        packer.finish(closed=False)
        yield from packer.table(schema, 0, part).to_batches()

    def merge(level: int, last: bool):
        def of_group(table: pa.Table) -> pa.Table:
            group = table.column("group")[0].as_py()
            packer = Packer(length, 1 if last else windows, 0 if last else max_pad, with_ids)
            rows = zip(*(table.column(c).to_pylist() for c in ("doc_id", "row", "start", "ids", "doc_tokens")))
            for piece in sorted(rows, key=lambda r: (-len(r[3]), r[1], r[2])):
                packer.place(*piece)
            packer.finish(closed=last)
            return packer.table(schema, level, group)

        return of_group

    texts = spread(docs.select("doc_id", utf8("text").alias("text")))
    done = shared_checkpoint(texts.mapInArrow(first, ddl))
    parts, level = done.rdd.getNumPartitions(), 0
    packed = done.where("closed")
    while parts >= 1:
        parts, level = -(-parts // FAN_IN) if parts > 1 else 0, level + 1
        last = parts <= 1
        left = done.where("not closed").withColumn("group", F.expr(f"part div {FAN_IN}"))
        done = shared_checkpoint(left.groupBy("group").applyInArrow(merge(level, last), ddl))
        packed = packed.union(done.where("closed"))
        if last:
            break
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"]
    return packed.select(*columns, *(["ids"] if with_ids else []))
