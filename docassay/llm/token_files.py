"""Files of token ids in fixed-width bits, as a Spark data source.

Every id takes the bits that the largest of the vocabulary needs, one after the
other, in blocks of BLOCK_IDS ids. A file is

    magic, bits, ids a block          (bytes 0 to 16)
    blocks                            each begins at a byte; all but the last are full
    index                             an Arrow stream of (doc_id, start in this file, number of ids)
    block table                       offset of each block and of their end, CRC-32 of each
    counts and places of the above, magic

so a reader takes any span of ids by the offsets of the blocks that hold it and
unpacks it in one numpy expression. `write_token_ids` sorts documents by id over
the cluster and writes a file for each partition; tasks hold a block and the
index of their file. A file is named after the task's attempt and counts only if
the manifest, which the driver writes last, names it: a lost executor's half of a
file is never read. The folder must be on storage that all executors reach
through `pyarrow.fs` (local or shared folders, HDFS, object stores).
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docassay.llm.common import pieces, utf8
from docassay.llm.tokens import byte_bpe

MAGIC = b"TOKIDS1\n"
FORMAT = "token_ids"
MANIFEST = "manifest.json"
#: Ids of a block, a multiple of 8; ids that a reading task takes at least, and in one go.
BLOCK_IDS, SPLIT_IDS, READ_IDS = 1 << 14, 1 << 24, 1 << 20
INDEX_ROWS = 1 << 16
CLOSING_ID = b"\0\0\0\0"


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, the lowest first; zeros fill the last byte."""
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id of {int(ids.max())} does not fit {bits} bits")
    spelled = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spelled[:, :bits].ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """`n` ids from the `first` on."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    byte, word = at >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype("<u4")


class TokenFileWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, out: BinaryIO, bits: int, id_type: pa.DataType, block_ids: int = BLOCK_IDS):
        if not 1 <= bits <= 32 or block_ids % 8:
            raise ValueError("1 to 32 bits an id, and a multiple of 8 ids a block")
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_docs = 0
        self.offsets, self.sums = [], []
        self.schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index, self.rows = io.BytesIO(), []
        self.index_stream = pa.ipc.new_stream(self.index, self.schema)
        self.at = 0
        self._write(MAGIC + np.array([bits, block_ids], "<u4").tobytes())

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        data = packed(ids, self.bits)
        self.offsets.append(self.at)
        self.sums.append(zlib.crc32(data))
        self._write(data)

    def _index_batch(self) -> None:
        columns = list(zip(*self.rows)) or [()] * 3
        self.index_stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        self.rows = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_ids, len(ids)))
        if len(self.rows) == INDEX_ROWS:
            self._index_batch()
        self.waiting.append(ids)
        self.n_waiting, self.n_ids, self.n_docs = self.n_waiting + len(ids), self.n_ids + len(ids), self.n_docs + 1
        if self.n_waiting >= self.block_ids:
            ids = np.concatenate(self.waiting)
            full = len(ids) - len(ids) % self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(ids[k : k + self.block_ids])
            self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        index_at = self.at
        self._index_batch()
        self.index_stream.close()
        self.offsets.append(index_at)
        self._write(self.index.getvalue())
        table_at = self.at
        self._write(np.array(self.offsets, "<u8").tobytes() + np.array(self.sums, "<u4").tobytes())
        self._write(np.array([self.n_ids, self.n_docs, len(self.sums), index_at, table_at], "<u8").tobytes() + MAGIC)


class TokenFile:
    """Random access to one file."""

    def __init__(self, data: BinaryIO):
        self.data = data
        data.seek(0, 2)
        size = data.tell()
        head, tail = self._read(0, 16), self._read(size - 48, 48)
        if head[:8] != MAGIC or tail[40:] != MAGIC:
            raise ValueError("not a file of token ids, or not all of one")
        self.bits, self.block_ids = (int(x) for x in np.frombuffer(head[8:], "<u4"))
        self.n_ids, self.n_docs, n_blocks, self.index_at, self.table_at = (int(x) for x in np.frombuffer(tail[:40], "<u8"))
        table = self._read(self.table_at, 12 * n_blocks + 8)
        self.offsets = np.frombuffer(table[: 8 * n_blocks + 8], "<u8").astype(np.int64)
        self.sums = np.frombuffer(table[8 * n_blocks + 8 :], "<u4")

    def _read(self, at: int, n: int) -> bytes:
        self.data.seek(at)
        return self.data.read(n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The `n` ids from `start` on, as little-endian unsigned 32-bit integers; only their blocks are read."""
        if n == 0:
            return np.zeros(0, "<u4")
        if start < 0 or start + n > self.n_ids:
            raise IndexError(f"ids {start} to {start + n} of {self.n_ids}")
        a, b = start // self.block_ids, (start + n - 1) // self.block_ids + 1
        data = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        for k in range(a, b):
            if zlib.crc32(data[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])]) != self.sums[k]:
                raise ValueError(f"block {k} is damaged")
        return unpacked(data, self.bits, start - a * self.block_ids, n)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """Batches of (doc_id, start, n_tokens) in order."""
        yield from pa.ipc.open_stream(self._read(self.index_at, self.table_at - self.index_at))


def _storage(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


@dataclass
class WrittenFile(WriterCommitMessage):
    part: int
    name: str
    n_ids: int
    n_docs: int


@dataclass
class Span(InputPartition):
    """Documents of a file that begin at ids `low` to `high` - 1 of it; `base` ids are in the files before."""

    name: str
    base: int
    low: int
    high: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, bits: int, block_ids: int):
        self.path, self.bits, self.block_ids = path, bits, block_ids
        self.kind = schema["doc_id"].dataType

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        from pyspark.sql.pandas.types import to_arrow_type

        storage, folder = _storage(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid4().hex}.tokens"
        storage.create_dir(folder, recursive=True)
        with storage.open_output_stream(f"{folder}/{name}") as out:
            file = TokenFileWriter(out, self.bits, to_arrow_type(self.kind), self.block_ids)
            for batch in iterator:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    file.add(doc_id, np.frombuffer(ids.as_py() or b"", "<u4"))
            file.close()
        return WrittenFile(context.partitionId(), name, file.n_ids, file.n_docs)

    def commit(self, messages: list[WrittenFile | None]) -> None:
        files = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        entries = [{"name": m.name, "n_ids": m.n_ids, "n_docs": m.n_docs} for m in files]
        storage, folder = _storage(self.path)
        storage.create_dir(folder, recursive=True)
        with storage.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"doc_id": self.kind.simpleString(), "bits": self.bits, "files": entries}).encode())

    def abort(self, messages: list[WrittenFile | None]) -> None:
        storage, folder = _storage(self.path)
        for m in messages:
            if m is not None:
                storage.delete_file(f"{folder}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, manifest: dict, split_ids: int):
        self.path, self.manifest, self.split_ids = path, manifest, split_ids

    def partitions(self) -> list[Span]:
        spans, base = [], 0
        for f in self.manifest["files"]:
            pieces = max(1, f["n_ids"] // self.split_ids)
            cuts = [f["n_ids"] * k // pieces for k in range(pieces)] + [f["n_ids"] + 1]
            spans += [Span(f["name"], base, a, b) for a, b in zip(cuts, cuts[1:])]
            base += f["n_ids"]
        return spans or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.name:
            return
        storage, folder = _storage(self.path)
        with storage.open_input_file(f"{folder}/{span.name}") as data:
            file = TokenFile(data)
            for batch in file.documents():
                starts = np.asarray(batch.column(1))
                own = batch.slice(a := int(np.searchsorted(starts, span.low)), int(np.searchsorted(starts, span.high)) - a)
                starts, counts = np.asarray(own.column(1)), np.asarray(own.column(2))
                at = 0
                while at < len(own):  # as many documents as have READ_IDS together, one at least
                    ends = starts[at:] + counts[at:] - starts[at]
                    n = max(1, int(np.searchsorted(ends, READ_IDS, side="right")))
                    low = int(starts[at])
                    data_of = file.ids(low, int(ends[n - 1])).tobytes()
                    cut = [data_of[4 * (s - low) : 4 * (s - low + c)] for s, c in zip(starts[at : at + n].tolist(), counts[at : at + n].tolist())]
                    arrays = [own.column(0).slice(at, n), pa.array(starts[at : at + n] + span.base), own.column(2).slice(at, n), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])
                    at += n


class TokenIds(DataSource):
    """`token_ids`: options path, bits, block_ids (writing), split_ids (reading).

    Written columns: doc_id of any type, ids binary (little-endian unsigned 32-bit
    integers; null is none). Read: doc_id, start long (ids of all documents before
    it), n_tokens long, ids binary.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _manifest(self) -> dict:
        storage, folder = _storage(self.options["path"])
        with storage.open_input_file(f"{folder}/{MANIFEST}") as data:
            return json.loads(data.read())

    def schema(self) -> str:
        return f"doc_id {self._manifest()['doc_id']}, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._manifest(), int(self.options.get("split_ids", SPLIT_IDS)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, int(self.options["bits"]), int(self.options.get("block_ids", BLOCK_IDS)))


def token_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids: each whole text's ids and a closing 0, little-endian; a null text has only the 0. Partitions and order stay."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("ids", pa.binary())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer_path).all_ids
        for part in pieces(batches, 1 << 20):
            ids = [encode((t.as_py() or b"").decode("utf-8", "replace")) + CLOSING_ID for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], schema=schema)

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(encoded, f"doc_id {kind.simpleString()}, ids binary")


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, bits: int | None = None) -> None:
    """All `docs` as files of token ids in the folder `path`, in ascending order of doc_id (null first, then by text).

    Rows that repeat an id are written as often as they are there; other columns
    are not read; an empty table leaves a manifest without documents. bits: what
    the vocabulary needs. Rows are range-partitioned by doc_id and a hash of the
    text, so that an id of very many rows is spread too.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    if bits is None:
        bits = bits_for(byte_bpe(tokenizer_path).vocabulary)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    ordered = keyed.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text")
    token_ids(ordered, tokenizer_path).write.format(FORMAT).option("path", path).option("bits", bits).mode("append").save()


def read_token_ids(spark: SparkSession, path: str, split_ids: int = SPLIT_IDS) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents in the folder `path`; a reading task takes some `split_ids` ids of a file."""
    spark.dataSource.register(TokenIds)
    return spark.read.format(FORMAT).option("path", path).option("split_ids", split_ids).load()
