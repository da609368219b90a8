import io
import json
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docassay.llm import q_token_files
from docassay.llm.token_files import TokenFile, TokenFileWriter, bits_for, packed, read_token_ids, unpacked, write_token_ids
from docassay.sources import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537, 2**32)] == [1, 1, 2, 8, 9, 16, 16, 17, 32]


@pytest.mark.parametrize("bits", range(1, 33))
def test_packed_and_unpacked(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1000, dtype=np.uint64).astype("<u4")
    data = packed(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    want = "".join(format(int(x), f"0{bits}b")[::-1] for x in ids)  # the bits, lowest first
    assert want == "".join(format(b, "08b")[::-1] for b in data)[: 1000 * bits]
    for first, n in ((0, 1000), (0, 0), (999, 1), (123, 456)):
        assert (unpacked(data, bits, first, n) == ids[first : first + n]).all()
    if bits < 32:
        with pytest.raises(ValueError):
            packed(np.array([2**bits], "<u4"), bits)


def file_of(lengths, bits=11, block_ids=64):
    rng = np.random.default_rng(len(lengths))
    docs = [rng.integers(0, 2**bits, n).astype("<u4") for n in lengths]
    out = io.BytesIO()
    file = TokenFileWriter(out, bits, pa.int64(), block_ids)
    for k, ids in enumerate(docs):
        file.add(k, ids)
    file.close()
    return docs, out.getvalue()


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


@pytest.mark.parametrize("lengths", [[], [0], [1], [64], [64, 64], [63, 2], [0, 0, 5, 0], [1000, 3, 0, 129]])
def test_random_access(lengths):
    docs, data = file_of(lengths)
    every = np.concatenate([np.zeros(0, "<u4"), *docs])
    file = TokenFile(io.BytesIO(data))
    assert (file.n_ids, file.n_docs, len(file.sums)) == (len(every), len(docs), -(-len(every) // 64))
    index = [tuple(r.values()) for b in file.documents() for r in b.to_pylist()]
    assert index == [(k, sum(lengths[:k]), n) for k, n in enumerate(lengths)]
    r = random.Random(1)
    for _ in range(50):
        a, b = sorted(r.randrange(len(every) + 1) for _ in range(2))
        assert (file.ids(a, b - a) == every[a:b]).all()
    with pytest.raises(IndexError):
        file.ids(0, len(every) + 1)


def test_only_the_blocks_asked_for_are_read():
    docs, data = file_of([100_000])
    counting = Counting(data)
    file = TokenFile(counting)
    counting.got = 0
    assert (file.ids(50_000, 10) == docs[0][50_000:50_010]).all() and counting.got <= 2 * 64 * 11 // 8
    assert len(data) < 100_000 * 11 / 8 * 1.2


def test_damage_is_found():
    _, data = file_of([1000])
    damaged = bytearray(data)
    damaged[200] ^= 1
    file = TokenFile(io.BytesIO(bytes(damaged)))
    with pytest.raises(ValueError, match="damaged"):
        file.ids(0, 1000)
    assert len(file.ids(900, 50)) == 50
    for broken in (data[:-1], data[:100], b"x" + data[1:]):
        with pytest.raises((ValueError, OSError)):
            TokenFile(io.BytesIO(broken))


@pytest.mark.parametrize("parts,split_ids", [(1, 50), (9, 1 << 24)])
def test_round_trip_of_odd_documents(spark, plain, tmp_path, parts, split_ids):
    r = random.Random(parts)
    docs = [(i * 7 % 150, " ".join(f"word{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    docs += [(900, None), (901, ""), (5, "again"), (5, "again"), (None, "no id"), (-3, "long " * 9000), (903, "end <|endoftext|> of \x00 it é 漢")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, start int, ids string").repartition(parts)
    path = f"file:{tmp_path}/ids"
    write_token_ids(df, path, PATH)
    found = read_token_ids(spark, path, split_ids)
    assert found.rdd.getNumPartitions() >= (50 if split_ids == 50 else 1)
    rows = sorted(found.collect(), key=lambda x: x.start)
    want = [(i, *plain(t)) for i, t in docs]
    assert sorted((x.doc_id is not None, x.doc_id or 0, *np.frombuffer(x.ids, "<u4").tolist()) for x in rows) == sorted((w[0] is not None, w[0] or 0, *w[1:]) for w in want)
    at = 0
    for before, x in zip([None, *rows], rows):
        assert x.start == at and x.n_tokens == len(x.ids) // 4
        assert before is None or before.doc_id is None or before.doc_id <= x.doc_id
        at += x.n_tokens
    manifest = json.loads(Path(f"{tmp_path}/ids/manifest.json").read_text())
    assert manifest["bits"] == 16 and sum(f["n_docs"] for f in manifest["files"]) == len(docs)
    on_disk = sum(p.stat().st_size for p in Path(f"{tmp_path}/ids").glob("*.tokens"))
    assert on_disk < 2 * at + 40 * len(docs) + 2000 * len(manifest["files"])


def test_what_the_manifest_does_not_name_is_not_read(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    write_token_ids(df, str(tmp_path / "t"), PATH)
    (tmp_path / "t" / "part-000000-99-lost.tokens").write_bytes(b"half a file of a task that died")
    assert read_token_ids(spark, str(tmp_path / "t")).count() == 20


def test_ids_of_text(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string")
    write_token_ids(df, str(tmp_path / "t"), PATH)
    assert [(x.doc_id, x.start) for x in read_token_ids(spark, str(tmp_path / "t")).orderBy("start").collect()] == [("a", 0), ("b", 2)]


def test_empty_table(spark, tmp_path):
    write_token_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), PATH)
    got = read_token_ids(spark, str(tmp_path / "none"))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "n_tokens", "ids"]


def test_the_query(spark, plain):
    docs = sorted((x.doc_id, x.text) for x in read_table(spark, "/root/testdata/sf0.001", "documents").collect())
    want, at = [], 0
    for i, t in docs:
        ids = plain(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, q_token_files.query(spark, "/root/testdata/sf0.001").collect())) == want
